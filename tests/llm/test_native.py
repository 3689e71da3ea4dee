"""Fingerprints, sharding and licenses: native plans, brute force, SQL, awkward rows."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, licenses, queries, sharding

D = "/root/testdata/sf0.001"
NATIVE = ["op3_fingerprint", "op4_chat", "op5_sharding", "op6_licenses"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_are_native(spark, name):
    plan = queries.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    found = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("ids", [[5], [0, 1, 2, 63, 64, 65, 255, 256, 257, 4095, 4096], [-70000, -3, 0, 9, 70000, 2**40, 2**62], [7, 7, 9]])
def test_next_document(spark, ids):
    docs = [(i, f"text {i} " + "w " * (abs(i) % 50)) for i in ids]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        if ids.count(i) > 1:
            continue
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert len(got) == len(set(ids))


def test_fingerprint_estimates(spark):
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(300, 1300))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"), fingerprint.sketch(F.concat_ws(" ", "a", "b")).alias("ab"))
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n"), (fingerprint.decode(fingerprint.encode(F.col("a"))) == F.col("a")).alias("same"), F.size(F.array_intersect(fingerprint.merge(F.col("a"), F.col("b")), "ab")).alias("m")).first()
    assert abs(r.r - 0.54) < 0.2 and abs(r.c - 0.7) < 0.25 and abs(r.n - 996) < 400 and r.same and r.m >= 60


def brute_fingerprint(text, k=fingerprint.K):
    """Distinct five-word runs; the hash is checked for being one of the run alone."""
    w = (text or "").lower().split() or [""]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints_equal_brute_force(spark):
    """Sketches are the k smallest hashes of exactly the distinct runs, and likeness follows from them alone."""
    import random

    rng = random.Random(6)
    texts = ["", " a b\n", "a b", "a  b\tc d e f", "A B C D E F"] + [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 160))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    runs = sorted({x for t in texts for x in brute_fingerprint(t)})
    size = [(i, *(list(x) + [None] * 5)[:5]) for i, x in enumerate(runs)]
    named = spark.createDataFrame(size, "i long, a string, b string, c string, d string, e string").select("i", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()
    value = {runs[r.i]: r.h for r in named}
    sketch = lambda t: sorted({value[x] for x in brute_fingerprint(t)})[: fingerprint.K]
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        a, b = sketch(texts[i]), sketch(texts[nxt])
        assert got[i].fingerprint == ".".join(f"{v % 2**64:x}" for v in a)
        union = sorted(set(a) | set(b))[: fingerprint.K]
        assert abs(got[i].near_next - len(set(union) & set(a) & set(b)) / len(union)) < 1e-12
        h = len(texts[i]) // 2
        edited = brute_fingerprint(texts[i][: len(texts[i]) - h] + texts[nxt][:h])
        if edited <= value.keys():
            e = sorted({value[x] for x in edited})[: fingerprint.K]
            union = sorted(set(a) | set(e))[: fingerprint.K]
            assert got[i].edited_fingerprint == ".".join(f"{v % 2**64:x}" for v in e)
            assert abs(got[i].near_edited - len(set(union) & set(a) & set(e)) / len(union)) < 1e-12
    assert got[1].fingerprint == got[2].fingerprint and got[0].fingerprint != got[2].fingerprint


def test_fingerprints_of_awkward_rows(spark, awkward, nothing):
    rows = fingerprint.edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1 and {r.n_chars for r in rows if r.doc_id in (1, 2)} == {0}
    assert fingerprint.edited_fingerprints(nothing).count() == 0
    assert fingerprint.edited_fingerprints(awkward.where("doc_id is null")).first().near_next == 1


def test_table_is_even_and_stable():
    full, less = sharding.fill(), sharding.fill(sharding.SHARDS[:-1])
    counts = [full.count(i) for i in range(32)]
    assert max(counts) - min(counts) <= 1 and set(full) == set(range(32))
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 31)
    assert moved < 0.05 * len(full)
    for bad in (((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_sharding_of_awkward_rows(spark, awkward, nothing, tmp_path):
    df = awkward.withColumn("slot", F.lit("old")).withColumn("shard", F.lit("old"))
    rows = sharding.place(df, "doc_id").collect()
    assert len(rows) == awkward.count() and len({r.shard for r in rows if r.doc_id == 4}) == 1
    want = {i: int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16) % sharding.SLOTS for i in (None, 1, 4)}
    assert all(r.slot == want[r.doc_id] for r in rows if r.doc_id in want)
    assert sharding.place(nothing, "doc_id").count() == 0
    sharding.write_shards(spark.range(500).withColumnRenamed("id", "k"), "k", f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").count().count() == 32


def test_licenses(spark, awkward, nothing):
    apache = ['Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"]
    rows = [(1, " ".join(apache)), (2, "\n".join([apache[1], apache[0], apache[2]])), (3, "Text. RELEASED  under the mit license!\nMore; Licensed under CC BY-NC 4.0.\n"), (4, "We discuss warranty and licensing."), (5, "Released under the MIT License. Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.identifiers, r.licenses) for r in licenses.scan(df).collect()}
    assert got[1] == (["apache-grant", "apache-comply", "apache-copy"], ["Apache-2.0"])
    assert got[2][1] == [] and len(got[2][0]) == 3
    assert got[3] == (["mit-named", "cc-by-nc"], ["MIT", "CC-BY-NC-4.0"])
    assert got[4] == ([], []) and got[5] == (["mit-named"] * 2, ["MIT"])
    rows = licenses.scan(awkward).collect()
    assert len(rows) == awkward.count() and [r.licenses for r in rows if r.doc_id == 8] == [["CC-BY-NC-4.0"]]
    assert licenses.scan(nothing).count() == 0


def test_every_rule_matches_its_own_sentences(spark):
    rows = [(i, "\n".join(licenses.SENTENCES[s] for s in rule)) for i, (_, rule) in enumerate(licenses.RULES)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.RULES):
        assert name in got[i], licenses.RULES[i]


WRAPPED = {
    "Apache-2.0": """# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
""",
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "BSD-3-Clause": """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
""",
    "GPL-2.0-or-later": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.",
    "Proprietary": "Copyright 2020 Somebody.  All rights  reserved.",
}


def test_wrapped_licenses(spark):
    rows = [(k, v) for k, v in WRAPPED.items()] + [(k + " crlf", v.replace("\n", "\r\n")) for k, v in WRAPPED.items()]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: [k.removesuffix(" crlf")] for k, _ in rows}


def test_runs_of_lines(spark):
    rows = ["Licensed under the\nMIT License.", "It is not Licensed under\nCC BY 4.0.", "All rights.\nReserved.", "Licensed under CC\n\x01\n BY\x01 4.0.\n\n\nAll\nrights\nreserved", "Software under the\nMIT License\n"]
    got = [r.identifiers for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["mit-licensed"], [], [], ["cc-by", "reserved"], ["mit-title"]]
    assert all(any(k in s for k in licenses.KEYWORDS) for s in licenses.known())


def test_every_sentence_wrapped_at_every_space(spark):
    """A line break, or two spaces, at any one space of any sentence doesn't lose it."""
    rows = []
    for name, text in licenses.SENTENCES.items():
        words = text.split(" ")
        rows += [(name, " ".join(words[:k]) + gap + " ".join(words[k:])) for k in range(1, len(words)) for gap in ("\n", "  ", "\n\t")]
        rows.append((name, text.replace(" ", "\n")))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    lost = {r.doc_id for r in got if r.doc_id not in r.identifiers}
    assert len(got) == len(rows) and not lost, lost


def test_tags(spark):
    rows = [("a", "# SPDX-License-Identifier: MIT\nimport x"), ("b", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("c", "// SPDX-License-Identifier: Unheard-Of-1.0"), ("d", "GNU General Public License v3.0")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ["MIT"], "b": ["GPL-3.0-or-later"], "c": [], "d": ["GPL-3.0"]}
