import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, most=3, least=10, inside=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        fit = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in fit.items():
            if any(100 * b >= inside * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in fit.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "On", "mat", "é", "ÉTÉ", "x", "日本", "zz"]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " "]) for _ in range(rng.randrange(0, 30)))
        rows += [(rng.choice(["en", "en", "de", None, "und"]), text)] * rng.choice([1, 1, 1, 6])
    return rows


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("p"), "piece": F.lit(1), "m": F.lit(7), "f": F.lit(None), "rank": F.lit(0)})
    return sorted(tuple(r) for r in collocations.mine(df.repartition(3), **more).collect())


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"most_words": 4, "least": 4}), (3, {"top": 5, "inside": 90})])
def test_equals_brute_force(spark, monkeypatch, seed, more):
    monkeypatch.setattr(collocations, "CHUNK", 900)
    rows = corpus(seed)
    want = brute(rows, **{{"most_words": "most"}.get(k, k): v for k, v in more.items()})
    assert mined(spark, rows, **more) == want != []


def test_buckets_larger_than_their_memory(spark, monkeypatch):
    """A bucket is counted in a file, so its memory is no bound on its phrases."""
    monkeypatch.setattr(collocations, "BUCKET_MEMORY", "24MB")
    df = spark.range(400_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.sha2((F.col("id") % 200_000).cast("string"), 256)).alias("phrase"), F.lit(5).cast("long").alias("f"))
    got = df.repartition(1).mapInArrow(collocations._bucket(10), collocations.COUNTS)
    assert got.agg(F.count("*"), F.sum("f")).first()[:] == (200_000, 2_000_000)


def test_awkward_rows(spark, awkward, nothing):
    assert mined(spark, [(None, None), ("en", ""), ("en", " \t\n.,")]) == []
    assert collocations.mine(nothing).count() == 0
    got = collocations.mine(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang, r.phrase, r.a) for r in got][:1] == [("und", "word word word", 29998)]
    big = 10**9
    assert spark.range(1).select(collocations._score(f"{big}L", f"{big + 1}L", f"{big + 7}L").alias("s")).first().s == 1_000_000 * big * big // ((big + 1) * (big + 7))
