"""Question routing, scope checks, audit rows and chat history over the conversations table (2.10).

Keyword rules are literal arrays inside the expressions (no join, no Python worker): each user turn is
matched against the ordered rule list with ``exists`` / ``contains``; the agent table is exploded per
question from a literal array, so the scope check never joins the questions with anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import block_window, blocked
from .. import config as C
from ..registry import query
from ..sources.tables import read_table

# FIXED VALUES: question topics, first matching group wins, default "stats".
TOPIC_RULES = [
    ("topk", ["top", "best", "popular", "rank", "recommend"]),
    ("rules", ["association", "rule", "together", "bundle", "basket"]),
    ("anomalies", ["anomal", "unusual", "outlier", "weird", "strange"]),
    ("model", ["feature", "import", "xgboost", "model", "predict", "accuracy"]),
    ("strategy", ["strategy", "insight", "overview", "summary", "report", "trend", "market", "competi"]),
]
DEFAULT_TOPIC = "stats"

# FIXED VALUES: agents in routing order with their allowed topic words; the strategy agent is the default.
AGENTS = [
    ("TopK Analysis Agent", ["top", "best", "rank", "popular", "recommend", "performance", "score", "success"]),
    ("Market Strategy Agent", ["strategy", "market", "trend", "insight", "overview", "summary", "report", "competi",
                               "segment", "cluster"]),
    ("Anomaly Detection Agent", ["anomal", "outlier", "unusual", "weird", "strange", "suspicious", "price issue",
                                 "discount"]),
    ("Product Enrichment Agent", ["description", "enrich", "rewrite", "product detail", "summarize product", "improve"]),
]
DEFAULT_AGENT = "Market Strategy Agent"
QUESTION_CHARS = 200
# Time of a message: the tables hold none, so an hour per conversation and a minute per position from here on.
AUDIT_START = C.AS_OF
HISTORY_MESSAGES = 3


def _any_word(q: F.Column, words) -> F.Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(q, F.lit(w))
    return out


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def route_questions(questions: DataFrame) -> DataFrame:
    q = F.lower(F.col("text"))
    topic = None
    for name, words in TOPIC_RULES:
        cond = _any_word(q, words)
        topic = F.when(cond, F.lit(name)) if topic is None else topic.when(cond, F.lit(name))
    return questions.select("conv_id", "turn", topic.otherwise(F.lit(DEFAULT_TOPIC)).alias("topic"))


def _sql_any(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("route_questions", "SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN {_sql_any(words)} THEN '{name}'" for name, words in TOPIC_RULES)
    + f" ELSE '{DEFAULT_TOPIC}' END AS topic FROM conversations WHERE role = 'user'")
def q_route_questions(spark: SparkSession, sf: str) -> DataFrame:
    return route_questions(user_questions(spark, sf))


def agent_for(q: F.Column) -> F.Column:
    out = None
    for name, words in AGENTS:
        cond = _any_word(q, words)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def route_agents(questions: DataFrame) -> DataFrame:
    q = F.lower(F.col("text"))
    routed = agent_for(q)
    return questions.select("conv_id", "turn", F.coalesce(routed, F.lit(DEFAULT_AGENT)).alias("agent"),
                            routed.isNotNull().alias("in_scope"))


ROUTE_AGENT_SQL = ("CASE " + " ".join(f"WHEN {_sql_any(words)} THEN '{name}'" for name, words in AGENTS) + " END")


@query("route_agents", f"""SELECT conv_id, turn, coalesce({ROUTE_AGENT_SQL}, '{DEFAULT_AGENT}') AS agent,
  ({ROUTE_AGENT_SQL}) IS NOT NULL AS in_scope FROM conversations WHERE role = 'user'""")
def q_route_agents(spark: SparkSession, sf: str) -> DataFrame:
    """First agent (in order) whose topic words occur; the strategy agent otherwise (then out of scope)."""
    return route_agents(user_questions(spark, sf))


def scope_check(questions: DataFrame) -> DataFrame:
    """In-scope flag of every agent for every question (agents exploded from a literal array)."""
    agents = F.array(*[F.struct(F.lit(n).alias("agent"), F.array(*[F.lit(w) for w in ws]).alias("topics"))
                       for n, ws in AGENTS])
    q = F.lower(F.col("text"))
    e = questions.select("conv_id", "turn", q.alias("_q"), F.explode(agents).alias("_a"))
    return e.select("conv_id", "turn", F.col("_a.agent").alias("agent"),
                    F.exists("_a.topics", lambda t: F.contains(F.col("_q"), t)).alias("in_scope"))


@query("scope_check", "SELECT conv_id, turn, agent, in_scope FROM (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{name}' AS agent, ({_sql_any(words)}) AS in_scope FROM conversations WHERE role = 'user'"
    for name, words in AGENTS) + ") t")
def q_scope_check(spark: SparkSession, sf: str) -> DataFrame:
    return scope_check(user_questions(spark, sf))


def refusal_text(agent: F.Column) -> F.Column:
    topics = F.create_map(*[x for n, ws in AGENTS for x in (F.lit(n), F.lit(", ".join(ws[:4])))])
    return F.concat(F.lit("This question is outside my scope ("), agent, F.lit("). I can only help with: "),
                    topics[agent], F.lit("."))


def audit_rows(conversations: DataFrame) -> DataFrame:
    """One audit row per user question: routed agent, question whole and its head for display, scope, response length
    (the next assistant turn, or the refusal text), refused flag. ``turn`` is the message position."""
    b = blocked(conversations.select("conv_id", "turn", "role", "text"), "turn", before=0, after=1)
    w = block_window("conv_id", "turn")
    nxt = b.select("conv_id", "turn", "role", "text", "_home",
                   F.lead("role").over(w).alias("_next_role"), F.lead("text").over(w).alias("_next_text"))
    qs = nxt.filter(F.col("_home") & (F.col("role") == "user"))
    routed = agent_for(F.lower(F.col("text")))
    agent = F.coalesce(routed, F.lit(DEFAULT_AGENT))
    in_scope = routed.isNotNull()
    answer = F.when(F.col("_next_role") == "assistant", F.col("_next_text")).otherwise(F.lit(""))
    resp = F.when(in_scope, F.length(answer)).otherwise(F.length(refusal_text(agent)))
    seconds = F.col("conv_id") * 3600 + F.col("turn") * 60
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(AUDIT_START).cast("timestamp")) + seconds), "yyyy-MM-dd HH:mm:ss")
    return qs.select("conv_id", "turn", ts.alias("ts"), agent.alias("agent"), F.col("text").alias("question"),
                     F.substring("text", 1, QUESTION_CHARS).alias("question_head"),
                     in_scope.alias("in_scope"), resp.alias("response_len"), (~in_scope).alias("refused"))


def _refusal_sql(agent_expr: str) -> str:
    return ("'This question is outside my scope (' || " + agent_expr + " || '). I can only help with: ' || CASE "
            + " ".join(f"WHEN {agent_expr} = '{n}' THEN '{', '.join(ws[:4])}'" for n, ws in AGENTS) + " END || '.'")


AUDIT_SQL = f"""WITH nx AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
q AS (SELECT *, {ROUTE_AGENT_SQL} AS routed FROM nx WHERE role = 'user')
SELECT conv_id, turn, strftime(TIMESTAMP '{AUDIT_START}' + to_seconds(conv_id * 3600 + turn * 60), '%Y-%m-%d %H:%M:%S') AS ts,
  coalesce(routed, '{DEFAULT_AGENT}') AS agent, text AS question, substring(text, 1, {QUESTION_CHARS}) AS question_head,
  routed IS NOT NULL AS in_scope,
  CASE WHEN routed IS NOT NULL THEN length(CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END)
       ELSE length({_refusal_sql("coalesce(routed, '" + DEFAULT_AGENT + "')")}) END AS response_len,
  routed IS NULL AS refused FROM q"""


@query("audit_rows", AUDIT_SQL)
def q_audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return audit_rows(read_table(spark, sf, "conversations"))


@query("refusal_rate", f"""WITH a AS ({AUDIT_SQL})
SELECT agent, count(*) AS n_questions, count(*) FILTER (WHERE refused) AS n_refused,
  floor(count(*) FILTER (WHERE refused) / CAST(count(*) AS DOUBLE) * 1000.0 + 0.5) / 1000.0 AS refusal_rate FROM a GROUP BY agent""")
def q_refusal_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Refusal rate per agent over the audit rows."""
    a = audit_rows(read_table(spark, sf, "conversations"))
    g = a.groupBy("agent").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("refused").alias("n_refused"))
    return g.withColumn("refusal_rate",
                        F.floor(F.col("n_refused") / F.col("n_questions") * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0))


def chat_history_window(conversations: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """For each user turn: the up to ``n`` messages before it as 'ROLE: text' lines, only once the
    chat holds more than two messages (the current one included). ``turn`` is the message position,
    so a long conversation is windowed block by block, not in one task."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    b = blocked(conversations.select("conv_id", "turn", "role", line.alias("_line")), "turn", before=n, after=0)
    w = block_window("conv_id", "turn")
    hist = F.array_join(F.collect_list("_line").over(w.rowsBetween(-n, -1)), "\n")
    out = b.select("conv_id", "turn", "role", "_home", F.when(F.col("turn") >= 2, hist).otherwise(F.lit("")).alias("history"))
    return out.filter(F.col("_home") & (F.col("role") == "user")).drop("role", "_home")


@query("chat_history_window", f"""SELECT conv_id, turn, history FROM (SELECT conv_id, turn, role,
  CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 2
       THEN array_to_string(list(upper(role) || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN {HISTORY_MESSAGES} PRECEDING AND 1 PRECEDING), chr(10)) ELSE '' END AS history
  FROM conversations) t WHERE role = 'user'""")
def q_chat_history_window(spark: SparkSession, sf: str) -> DataFrame:
    return chat_history_window(read_table(spark, sf, "conversations"))
