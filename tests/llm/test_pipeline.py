"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from vitrine.llm import packing, quality_rules
from vitrine.llm.queries import QUERIES

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    r = random.Random(11)
    vocabulary = ["".join(r.choice(["ta", "re", "mi", "so", "lu", "en"]) for _ in range(r.randint(2, 4))) for _ in range(500)]

    def line(n):
        return " ".join(r.choice(vocabulary) for _ in range(n)) + "."

    texts = ["\n".join(line(r.randint(6, 12)) for _ in range(r.randint(2, 6))) for _ in range(60)]
    shared = "\n".join(line(9) for _ in range(4))
    items = [line(20), line(25)]
    texts[3] += "\n" + shared
    texts[9] = shared + "\n" + texts[9]
    texts[20] = "\n".join([line(8), items[0], line(7)])
    texts[21] = texts[22].replace("\n", " ") + " " + line(3)  # two lines become one: similar words, other lines
    texts += [texts[5], texts[7].replace(texts[7].split()[4], "other"), " ".join(w + "***" for w in texts[8].split()), "too short", "", None]
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages(llm, tmp_path):
    items = _tables(llm, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]
    docs = llm.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(llm, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = llm.read.parquet(f"{tmp_path}/{name}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
            kept = {r.doc_id: r.text for r in rows}
            assert len(kept) == len(rows)
        if name == "quality_rules":
            scores = {r.doc_id: r.kept for r in quality_rules.score(docs, quality_rules.trusted(llm.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
            assert kept == {k: t for k, t in before.items() if scores[k]}
            assert set(range(60)) <= set(kept) and not {63, 64, 65} & set(kept)
        elif name == "line_dedup":
            deduped = brute.line_dedup(list(before.items()))
            assert kept == {k: t for k, t in deduped.items() if t == before[k] or t.split()}
            assert 60 in set(deduped) - set(kept)  # a copy: all its lines stand earlier
            assert any(kept[k] != before[k] for k in kept)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_join":
            found = brute.components(list(before.items()))
            assert kept == {k: t for k, t in before.items() if found[k][1] == k} and len(kept) < len(before)
        elif name == "decontamination":
            assert set(before) - set(kept) == {k for k, t in before.items() if any(i in t for i in items)} == {20}
        else:
            tokenizer = Tokenizer.from_file(packing.tokenizer_path())
            for k, t in before.items():
                ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
                own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
                assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in own] == [c for _, _, c in own]
                assert sum(n for _, n, _ in own) == len(ids)
        docs = after
    whole = sorted(zip(*[corpus_pipeline.run(llm, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").toPandas()[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]))
    assert whole == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
