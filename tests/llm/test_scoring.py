import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries, toxicity

D = "/root/testdata/sf0.1"
here = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


@here
@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.queries()[name](spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").toPandas()
    buckets, bucket = (5, 0) if label == "quality" else (3, 1)
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % buckets == bucket for i in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all()
    test = rows[rows["held_out"]]
    assert (test["predicted"] == test[label]).mean() >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, awkward, nothing, labels, module):
    rows = module.score_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (4, 5)]
    assert len(set(same)) == 1
    assert module.score_documents(nothing, labels).count() == 0
    bare = module.score_documents(awkward, labels.where("false")).collect()
    assert {r.score for r in bare} == {0.5} or all(0 <= r.score <= 1 for r in bare)


def test_filters_keep_columns(spark, awkward, labels):
    for kept in (quality.keep_good(awkward, labels), toxicity.keep_civil(awkward, labels)):
        assert kept.columns == awkward.columns
        kept.collect()


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "bad $$$ %%% ### " * 9 if i % 4 == 0 else "a plain line of words. " * 9) for i in range(400)], "doc_id long, text string")
    lab = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = lab.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_documents(docs, lab).collect()}
    assert a == {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert min(a[i] for i in range(400) if i % 4) > 0.5 > max(a[i] for i in range(0, 400, 4))


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    good = lambda: quality.encode("some plain words here. " * 60)
    mixed = lambda: quality.encode("some plain words here. " * 45 + "|%$#" * 90)
    y = rng.integers(0, 2, 80)
    model = quality.AttentionMil().fit([good() if v else mixed() for v in y], y)
    assert (model.score(["some plain words here. " * 60])[0] > 0.9) and (model.score(["some plain words here. " * 45 + "|%$#" * 90])[0] < 0.1)


def test_gradient():
    """The learned step lowers the loss of its own sample."""
    bags = [quality.encode(("ab " if i % 2 else "## ") * (40 + i)) for i in range(20)]
    y = np.array([i % 2 for i in range(20)])
    few, many = (quality.AttentionMil().fit(bags, y, rounds=r) for r in (2, 100))
    loss = lambda m: -np.mean(np.log(np.abs(m.score([("ab " if i % 2 else "## ") * (40 + i) for i in range(20)]) - (1 - y)) + 1e-9))
    assert loss(many) < loss(few)


def kinds(text, **more):
    return [int(k) for k in np.nonzero(toxicity.Grammar(**more).matches(text)[: toxicity.N_KINDS])[0]]


def test_grammar():
    assert kinds("what an idiot") == [toxicity.PLAIN]
    assert kinds("you are an idiot") == [toxicity.AIMED]
    assert kinds("he is not an idiot") == [toxicity.NEGATED]
    assert kinds("she said he is an idiot") == [toxicity.REPORTED]
    assert kinds("she said hello. what an idiot") == [toxicity.PLAIN]
    assert kinds("I will kill time") == []
    assert kinds("you I will kill") == [toxicity.MENACE]
    assert kinds("a fine day") == [] and kinds("") == [] and kinds(None) == []
    assert kinds("ein loweisch", stems={"lowe": 1.0}) == [toxicity.PLAIN]


def test_threat_before_its_target():
    menaces = lambda text: toxicity.Grammar().matches(text)[toxicity.MENACE]
    assert kinds("I will kill you") == [toxicity.MENACE] and kinds("we hurt you") == [toxicity.MENACE]
    assert menaces("kill a b c d you") == 1 and menaces("kill a b c d e you") == 0
    assert menaces("kill, hurt and burn you") == menaces("you we kill, hurt and burn") == 3
    assert menaces("kill you you") == 1 and menaces("you I will kill you") == 1
    assert menaces("I will kill. you") == 0
    assert kinds("I will not kill you") == [toxicity.NEGATED] and kinds("he said kill you") == [toxicity.REPORTED]


@pytest.mark.parametrize("text", ["what an “idiot”", "idiot… again", "¡idiota!", "«stupid»", "idiot—really", "idiot’s"])
def test_any_punctuation_ends_a_word(text):
    assert kinds(text, words={"idiota": 1.0}) == [toxicity.PLAIN]
    assert {"idiot", "idiota", "stupid"} & toxicity._entries(text)


def test_scan_never_excludes_what_the_grammar_matches():
    rng = np.random.default_rng(5)
    marks = [*"“”…¡«»—’_-. \u00a0\u2003²٣\u0301", ""]
    for _ in range(300):
        text = "".join(rng.choice(marks) + rng.choice(["idiot", "you", "plain", "stup"]) for _ in range(6))
        found = any(w in toxicity.INSULTS for w in toxicity._WORD.findall(text))
        assert bool(kinds(text)) == found, text


def test_reports_end():
    assert kinds("he said you are an idiot, and I agree you idiot") == [toxicity.AIMED, toxicity.REPORTED]
    assert kinds("he said you are an idiot and a moron") == [toxicity.REPORTED]
    assert kinds("he said “you idiot, and you moron” to me, you clown") == [toxicity.AIMED, toxicity.REPORTED]
    assert kinds('she wrote "what an idiot" about that moron') == [toxicity.PLAIN, toxicity.REPORTED]
    assert kinds("he said: you are an idiot") == [toxicity.REPORTED] and kinds("one thing: you are an idiot") == [toxicity.AIMED]
    assert kinds("they essaid: you are an idiot") == [toxicity.AIMED]
    assert kinds("“idiot”, and nothing else") == [toxicity.PLAIN]


def test_contracted_negations_and_more_speech():
    for text in ("you don't kill", "I won't hurt you", "I won’t hurt you", "you aren't an idiot", "He isn't stupid", "tu n'es idiot", "we dont hurt you"):
        assert kinds(text) == [toxicity.NEGATED], text
    for text in ("They say you are an idiot", "he told me you are an idiot", "sie sagen du idiot", "dicen que tú idiot"):
        assert kinds(text) == [toxicity.REPORTED], text
    assert kinds("I told you, you idiot") == [toxicity.AIMED]
    assert kinds("he said ‘you are an idiot’ and you idiot") == [toxicity.AIMED, toxicity.REPORTED]
    assert kinds("he said 'you are an idiot' about you moron") == [toxicity.AIMED, toxicity.REPORTED]
    assert kinds("you're an idiot") == [toxicity.AIMED] and kinds("the dog’s owner is an idiot") == [toxicity.PLAIN]


def test_share_of_clauses():
    got = toxicity.Grammar().matches("what an idiot. a fine day! ... and then? you clown")
    assert got[toxicity.N_KINDS] == 2 and got[toxicity.N_KINDS + 1] == 50.0


@pytest.mark.parametrize("rows,n_neg,n_pos,words,stems", [
    ([("vile", 0.0, 40.0), ("plain", 300.0, 40.0)], 400.0, 50.0, {"vile"}, set()),
    ([("lowe*", 0.0, 40.0), ("lowest", 0.0, 9.0), ("lowers", 1.0, 30.0)], 400.0, 50.0, set(), {"lowe"}),
    ([("rare", 0.0, 1.0)], 400.0, 50.0, set(), set()),
])
def test_entries_beyond_chance(rows, n_neg, n_pos, words, stems):
    got = toxicity.select_entries(rows, 100, n_neg, n_pos)
    assert (set(got[0]), set(got[1])) == (words, stems)


def interpret(text, grammar):
    """The composed transducer, step by step over a whole text, without tables and without a scan before."""
    sums, clauses = np.zeros(toxicity.N_SUMS), 0
    for clause in toxicity._CLAUSE.split(toxicity._plain(text or "")):
        clauses += bool(toxicity._TOKEN.search(clause))
        machine = toxicity.composed()
        state, matched = machine.start, False
        for token in toxicity._TOKEN.findall(clause):
            symbol, weight = toxicity._SYMBOL.get(token, toxicity.OTHER), 1.0
            if symbol in (toxicity.OTHER, toxicity.INSULT):
                weight = grammar.weight(token)
                symbol = toxicity.INSULT if weight > 0 else toxicity.OTHER
            state, kind = machine.step(state, (symbol, 0))
            if kind > toxicity.MENACE:
                kind, weight = toxicity.MENACE, 1.0 + kind - toxicity.MENACE
            if kind:
                sums[kind] += weight
                matched |= kind in (toxicity.PLAIN, toxicity.AIMED, toxicity.MENACE)
        sums[toxicity.N_KINDS] += matched
    sums[toxicity.N_KINDS + 1] = 100 * sums[toxicity.N_KINDS] / max(1, clauses)
    return sums


def test_equals_an_interpreter_on_whole_texts():
    rng = np.random.default_rng(9)
    bits = ["idiot", "Moron", "stupid", "KILL", "hurt", "you", "du", "not", "never", "said", "wrote", "and", "a", "plain", "lowest", ",", ", and", ", but", '"', "“", "”", ".", "!", ":", "\n", "said:", "—", "don't", "isn’t", "‘", "’", "say", "told me"]
    model = toxicity.Grammar(words={"vile": 0.5}, stems={"lowe": 0.7})
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.integers(0, 60)))
        assert np.allclose(model.matches(text), interpret(text, model)), text


def test_copies_share_a_weight_and_none_is_dropped(spark):
    rows = [("one two three four five six", 1)] * 3 + [("one two three four five six", 0), ("seven eight nine ten eleven twelve", 0)]
    got = toxicity._shared_weights(spark.createDataFrame(rows, "text string, y int")).collect()
    assert sorted((r.y, r.share) for r in got) == [(0, 0.25), (0, 1.0), (1, 0.25), (1, 0.25), (1, 0.25)]


def test_calibration_equals_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (200, toxicity.N_KINDS + 1)).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(1.0 - x[:, 2]))).astype(float)
    share = rng.choice([1.0, 0.5], 200)
    model = toxicity.Grammar().calibrate(x, y, share)
    z, w = np.hstack([np.log1p(x), np.ones((200, 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.array([0.1] * x.shape[1] + [1e-6])
    for _ in range(20000):
        w -= 0.01 * (z.T @ (share * (1 / (1 + np.exp(-z @ w)) - y)) + ridge * w)
        w[:-1] = np.maximum(w[:-1], 0)
    assert np.allclose(np.append(model.weights, model.bias), w, atol=0.02)


def test_samples_are_bounded(spark):
    from tidemark.llm.common import training_rows

    docs = spark.createDataFrame([(i, f"{i} " + "x" * 100) for i in range(300)] + [(7, "again")] * 5, "doc_id long, text string")
    lab = docs.select("doc_id", F.lit(1).alias("toxic")).distinct()
    free = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = lambda most, size: training_rows(docs, lab, "toxic", 3, 1, most, size)
    assert rows(1000, 1 << 20).count() == len(free) and rows(20, 1 << 20).count() == 20
    few = rows(1000, 1050)
    assert 9 <= few.count() <= 11 and set(few.toPandas()["text"]) <= set(rows(20, 1 << 20).toPandas()["text"])
    assert rows(1000, 1).count() == 1


def test_passages_cut_between_words():
    text = ("wort " * 300 + "é" * 700 + " " + "x" * 1100 + " end").encode()
    parts = quality.passages(text)
    assert b"".join(parts) == text and all(0 < len(p) <= quality.PASSAGE for p in parts)
    assert all(p.decode() for p in parts) and not any(p.endswith(b"wor") for p in parts)
    assert quality.passages(b"") == [b""] and len(quality.encode("")) == 1


def test_machine_equals_the_transducers():
    moves, out = toxicity.grammar()
    rng = np.random.default_rng(1)
    for _ in range(50):
        machine = toxicity.composed()
        state, at = machine.start, 0
        for s in rng.integers(0, 8, 30).tolist():
            state, want = machine.step(state, (s, 0))
            assert out[at][s] == want
            at = moves[at][s]
