import random

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def texts():
    rng = random.Random(5)
    out = ["", " ", "   a  b ", "\n\n", "x\n y\n", "a▁b", "日本語テキスト", "\x00\x01", "𐍈 emoji 😀👍🏽", "a" * 500, "ab" * 300 + " " * 50 + "1234567890" * 30, "Hello world! It's 2024, don't (you) know?", "mixed Ünïcödé ÄÖÜ ñandú été"]
    out += ["".join(rng.choice("abcde ,.\n▁éXYZ019-_=  thein") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    return out + ["".join(rng.choice("etaoinshrdlu ") for _ in range(200)) for _ in range(100)]


def test_equals_the_library(model, own):
    e = pieces.Encoder(model)
    for start in range(0, len(texts()), 100):
        part = texts()[start : start + 100]
        ids, at = e.encode_batch(part)
        back = e.decode_batch(ids, at)
        for k, t in enumerate(part):
            want = own.encode(t)
            assert ids[at[k] : at[k + 1]].tolist() == want, t[:60]
            assert back[k] == own.decode(want) == t.replace("▁", " ")


def test_words_are_forgotten_within_bounds(model, own, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 20)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 10)
    e = pieces.Encoder(model)
    for t in texts()[-30:]:
        ids, _ = e.encode_batch([t, None, t])
        assert ids.tolist() == own.encode(t) * 2
        assert len(e.known) <= 20 + len(set(e.words(t)))


def test_binary_search():
    keys = np.sort(np.random.default_rng(0).integers(0, 50, (200, 1)).astype(np.uint64), axis=0)
    want = np.arange(-1, 60).clip(0).astype(np.uint64)[:, None]
    assert (pieces._search(keys, want, False) == np.searchsorted(keys[:, 0], want[:, 0], "left")).all()
    assert (pieces._search(keys, want, True) == np.searchsorted(keys[:, 0], want[:, 0], "right")).all()


def test_awkward_rows(spark, awkward, nothing, own):
    coded = pieces.encode(awkward)
    rows = coded.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id == 1:
            assert (r.n_tokens, r.ids, r.round_trip) == (None, None, None)
        else:
            assert r.round_trip and r.n_tokens == len(r.ids)
    assert [r.ids for r in rows if r.doc_id == 2] == [[]]
    back = sorted(((r.doc_id or 0), r.text) for r in pieces.decode(coded).collect() if r.text is not None)
    assert back == sorted(((r.doc_id or 0), r.text) for r in awkward.collect() if r.text is not None)
    assert pieces.encode(nothing).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.PieceModel("/nonexistent.model")
