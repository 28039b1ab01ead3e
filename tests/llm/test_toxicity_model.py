"""Compression distance: what the windows and dictionaries do, and held-out accuracy on the shared tables."""

import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from triplewright.llm import toxicity as T


def plain_evidence(model, text):
    """Lengths under compressors made anew for each window."""
    words, out = text.lower().split(), []
    for i in range(0, max(len(words), 1), T.WINDOW):
        data = T.PAD + " ".join(words[i : i + T.WINDOW]).encode() + b" "
        if words:
            out.append(len(T.compressor(model.ordinary + model.background).compress(data)) - len(T.compressor(model.toxic + model.background).compress(data)))
    return out or [0]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    syllables = ["tha", "ren", "ing", "sto", "mel", "kor", "ati", "une"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(100)]
        if i % 3 == 0:
            words[7::20] = rng.choice(["you vilescum", "grubwart that", "snotface"], 5)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return pd.DataFrame(rows, columns=["doc_id", "text", "toxic"])


def test_evidence_by_plain_compression(sample):
    model = T.train(sample)
    for text in [*sample.text[:4], "", " \n", "short", "x" * 5000, "Ünïcode 🙂 " * 30]:
        assert T.Scorer(model).evidence(text).tolist() == plain_evidence(model, text)
    assert len(model.toxic) == len(model.ordinary) and len(model.background) <= T.BACKGROUND_BYTES


def test_windows_hold_every_word_and_both_dictionaries_decide(sample):
    text = " ".join(f"w{i}" for i in range(50))
    assert " ".join(T.windows_of(T.words_of(text))) == text and len(T.windows_of(T.words_of(text))) == -(-50 // T.WINDOW)
    model = T.train(sample)
    s = T.Scorer(model)
    plain = sample.text[1]
    phrase = plain.replace(" ", " grubwart that ", 1)
    assert s.evidence(phrase).max() > s.evidence(plain).max()
    same = T.Scorer(T.ToxicityModel(model.ordinary, model.ordinary, model.background, model.mean, model.spread, model.weights))
    assert not same.evidence(phrase).any()  # without the toxic dictionary nothing is told apart


def test_held_out_labels():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    d = docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id").dropna()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in d.doc_id])
    model = T.train(d[~held][["doc_id", "text", "toxic"]])
    found, truth = T.Scorer(model).score(d[held].text.tolist()) >= T.PREDICT_AT, d[held].toxic.to_numpy() == 1
    assert (found & truth).sum() / found.sum() > 0.85 and (found & truth).sum() / truth.sum() > 0.4


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "word " * 200, int(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(T, "train", lambda sample, share=None: seen.append(sample.groupby("toxic").text.agg(lambda t: t.str.len().sum())))
    monkeypatch.setattr(T, "SAMPLE_BYTES", 50_000)
    T.fit(df.drop("toxic"), df.drop("text"))
    assert (seen[0] < 80_000).all() and (seen[0] > 20_000).all()
