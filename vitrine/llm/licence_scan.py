"""Licence scan: known licence sentences become identifiers, ordered rules match the identifier sequence.

A text is cut after sentence ends and at line feeds; a second cut lets sentences run over line feeds, as
licence texts are wrapped. Each sentence is normalised (ASCII letters and digits, small, single spaces)
and looked up; the identifiers, in order, form a sequence per cut. A rule is an ordered list of
identifiers that has to occur in this order, others may stand between. A rule that is a special case of
another (``implies``) silences it.

Native: split, transform, filter and regular expressions of Spark SQL; no shuffle. Texts without any of
``KEYWORDS`` hold no known sentence (each sentence has one of them) and skip the cuts.

Defined cases: null and empty texts have no sentences and no licence; a sentence found twice is listed
twice; equal rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.runtime import let

# Sentences of public licences and notices, one identifier each.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed-long": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "reserved": "All rights reserved.",
}
# Rules in order of report, (licence, identifiers in order).
RULES = [
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-licensed-long", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-copy"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("proprietary", ["reserved"]),
]
#: A licence that silences another when both match.
IMPLIES = [("BSD-3-Clause", "BSD-2-Clause")]
# Every sentence holds one of these (small letters, no separator inside, so neither line feeds nor
# punctuation between words hide one).
KEYWORDS = ["licen", "copyright", "permi", "redistribut", "warrant", "reserved"]


def normal(sentence: str) -> str:
    """Normal form of a sentence (driver side, for the fixed list)."""
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def pieces_of(sentence: str) -> list[str]:
    """Normal forms of what the cuts leave of a known sentence (one that holds a sentence end is several)."""
    return [n for x in re.sub("([.;!?])[ \t\n\r\f]+", r"\1\n", sentence).split("\n") if (n := normal(x))]


def known() -> dict[str, str]:
    """Normal form -> identifier; a sentence with an end inside is known by its longest part."""
    return {max(pieces_of(s), key=len): name for name, s in SENTENCES.items()}


def rule_pattern(identifiers: list[str]) -> str:
    """Pattern over " a  b  c " that holds when the identifiers occur in this order."""
    return ".*".join(f" {i} " for i in identifiers)


def _identifiers(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    lines = F.split(F.regexp_replace(text, "([.;!?])[ \t\n\r\f]+", "$1\n"), "\n")
    forms = F.transform(lines, lambda x: F.lower(F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))))
    return F.filter(F.transform(forms, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers of the cut that finds more, the line-wise one if equal), licences."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.lower(text).rlike("|".join(KEYWORDS)).alias("may"))
    none = F.array().cast("array<string>")
    wrapped = F.regexp_replace(F.regexp_replace("text", "\n[ \t\r\f]*\n", ".\n"), "([^.;:!?\n])[ \t\r\f]*\n", "$1 ")
    found = cut.select("doc_id", F.when(F.col("may"), _identifiers(F.col("text"))).otherwise(none).alias("a"), F.when(F.col("may"), _identifiers(wrapped)).otherwise(none).alias("b"))

    def matches(ids: Column, rule: list[str]) -> Column:
        return F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).rlike(rule_pattern(rule))

    def named(licence: str) -> Column:
        hit = F.lit(False)
        for name, rule in RULES:
            if name == licence:
                hit = hit | matches(F.col("a"), rule) | matches(F.col("b"), rule)
        return hit

    names = list(dict.fromkeys(name for name, _ in RULES))
    listed = F.array(*[F.when(named(n) & ~(named(next((x for x, y in IMPLIES if y == n), "")) if any(y == n for _, y in IMPLIES) else F.lit(False)), F.lit(n)) for n in names])
    return found.select("doc_id", F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")).alias("sentences"), F.filter(listed, lambda x: x.isNotNull()).alias("licences"))


def oracle() -> str:
    """DuckDB SQL of ``scan`` over ``documents``, with both lists joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known().items())
    rules = ", ".join(f"({i}, {quote(n)}, {quote(rule_pattern(r))})" for i, (n, r) in enumerate(RULES))
    return f"""
WITH known(form, name) AS (VALUES {values}),
rules(no, licence, pattern) AS (VALUES {rules}),
texts AS (
  SELECT doc_id, 0 AS cut, coalesce(text, '') AS t FROM documents
  UNION ALL
  SELECT doc_id, 1, regexp_replace(regexp_replace(coalesce(text, ''), '\\n[ \\t\\r\\f]*\\n', '.' || chr(10), 'g'), '([^.;:!?\\n])[ \\t\\r\\f]*\\n', '\\1 ', 'g') FROM documents
), lines AS (
  SELECT doc_id, cut, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, cut, string_split(regexp_replace(t, '([.;!?])[ \\t\\n\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)) AS x FROM texts)
), ids AS (
  SELECT doc_id, cut, i, name FROM lines
  JOIN known ON form = lower(trim(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g'), ' '))
), seqs AS (
  SELECT doc_id, cut, count(*) AS n, string_agg(name, ',' ORDER BY i) AS s, ' ' || string_agg(name, '  ' ORDER BY i) || ' ' AS q
  FROM ids GROUP BY 1, 2
), hits AS (
  SELECT doc_id, licence, min(no) AS no FROM seqs, rules WHERE regexp_matches(q, pattern) GROUP BY 1, 2
), lic AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY no) AS licences FROM hits h
  WHERE NOT (licence = 'BSD-2-Clause' AND EXISTS (SELECT 1 FROM hits g WHERE g.doc_id = h.doc_id AND g.licence = 'BSD-3-Clause'))
  GROUP BY 1
)
SELECT d.doc_id, coalesce(CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN b.s ELSE a.s END, '') AS sentences,
       coalesce(l.licences, '') AS licences
FROM documents d
LEFT JOIN seqs a ON a.doc_id = d.doc_id AND a.cut = 0
LEFT JOIN seqs b ON b.doc_id = d.doc_id AND b.cut = 1
LEFT JOIN lic l ON l.doc_id = d.doc_id
"""
