"""The attention model against plain loops over its definition, and the words' numbers."""

import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest

from triplewright.llm import lm_score as L

JSON = P.path("byte_bpe_50k.json")


def small_model(rng, vocabulary=40):
    classes, within = L.classes_of(rng.integers(0, 50, vocabulary), rng.integers(0, 3, vocabulary))
    model = L.Attention.start(vocabulary)
    model.matrix = rng.normal(0, 0.5, model.matrix.shape)
    return model, classes, within


def plain_score(model, classes, within, ids, begin):
    """log10 probability of the ids, position by position."""
    d, e, total = model.dense(), model.matrix, 0.0
    near, bias, half = d["near"].reshape(-1), d["bias"].reshape(-1), L.WINDOW // 2
    inputs = [begin, *ids[:-1]]
    for t, goal in enumerate(ids):
        first = max(0, (t // half - 1) * half)  # the window's first input
        x = e[inputs[t]]
        scores = np.array([x @ d["query"] @ (e[inputs[j]] @ d["key"]) / L.DIM**0.5 + near[t - j] for j in range(first, t + 1)])
        w = np.exp(scores - scores.max())
        w /= w.sum()
        mix = sum(w[j - first] * (e[inputs[j]] @ d["value"]) for j in range(first, t + 1))
        z = d["out"] @ mix + d["skip"] @ x + bias
        total += (z[classes[goal]] - np.log(np.exp(z).sum())) / np.log(10) + within[goal]
    return total


def test_scores_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    model, classes, within = small_model(rng)
    texts = [rng.integers(0, 40, n) for n in (1, 15, 16, 17, 33, 100, 1, 64, 2)]
    sizes = np.array([len(x) for x in texts])
    for at_once in (2, 128):
        monkeypatch.setattr(L, "_SCORED_AT_ONCE", at_once)
        got = L.Scorer(model, classes, within).score(np.concatenate(texts), sizes, 3)
        assert got == pytest.approx([plain_score(model, classes, within, x.tolist(), 3) for x in texts])


def test_a_strip_trains_as_its_windows_do():
    rng = np.random.default_rng(2)
    model, classes, _ = small_model(rng)
    texts = [rng.integers(0, 40, n) for n in (20, 1, 50)]
    strip = L.strip_of(np.concatenate(texts), np.array([20, 1, 50]), 40, 3)
    windows = [np.concatenate(x) for x in zip(*(L.windows_of(x, 40, 3) for x in texts), strict=True)]
    a, b = (L.Trainer(L.Attention(model.matrix.copy(), 40), classes) for _ in range(2))
    assert a.strip(*strip) == pytest.approx(b.step(*windows))
    assert a.m.matrix == pytest.approx(b.m.matrix)


def test_words_have_the_ids_of_the_text():
    encoder = L._encoder(JSON)
    texts = ["The quick brown fox", "", "a\tb\n c  it's 12,5%", "Ünïcode 日本語 🙂", "x" * 5000, "The quick", "<|endoftext|>"]
    lexicon = L.Lexicon(encoder, 50_256, {b"the": -1.0}, most=4)
    for _ in range(2):
        for part in (texts, texts[:1], texts[2:4]):
            ids, sizes, numbers, counts = lexicon.read(part)
            want = [np.append(L.subwords(encoder, L.words_of(t)), 50_256) for t in part]
            assert ids.tolist() == np.concatenate(want).tolist() and sizes.tolist() == [len(w) for w in want]
            assert counts.tolist() == [len(L.words_of(t)) + 1 for t in part]
            assert [lexicon.names[n] for n in numbers] == [w for t in part for w in [*L.words_of(t), b"\xff"]]
    numbers = lexicon.read(["The the fox"])[2]
    known = lexicon.log[numbers]
    assert known[:2].tolist() == [-1.0, -1.0] and np.isnan(known[2]) and known[3] == 0


def test_frequent_words_are_bounded_and_all_of_a_count(spark):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([1000, 500, 500, 500, 3, 3, 3, 1])]
    counts = spark.createDataFrame(rows, "word binary, c long")
    assert L._frequent(counts, 8) == dict(rows)
    assert L._frequent(counts, 6) == dict(rows[:4])
    assert L._frequent(counts, 3) == dict(rows[:1])
    assert L._frequent(counts, 0) == {} == L._frequent(counts.limit(0), 5)


def test_words_split_as_bytes_do():
    rng = np.random.default_rng(4)
    cases = [b"", b" ", b"a", b"\t a  b\x0bc\x0c\n\r", b"\x00 \xff \x1c\x1f a\x85b", *(rng.choice([9, 10, 13, 28, 32, 65, 133, 255], 40).astype(np.uint8).tobytes() for _ in range(200))]
    for data in cases:
        assert L.split(data).to_pylist() == data.split()


def test_steps_use_their_arrays_again():
    """A step's large arrays are made once: later steps allocate less than the exponentials of one."""
    rng = np.random.default_rng(6)
    classes, within = L.classes_of(rng.integers(0, 50, 40), rng.integers(0, 3, 40))
    model = L.Attention.start(40)
    ids = rng.integers(0, 40, L.BATCH * L._STEP)
    strip = L.strip_of(ids, np.array([len(ids)]), 40, 3)
    trainer, scorer = L.Trainer(model, classes), L.Scorer(model, classes, within)
    for step in (trainer.strip, scorer.strip):
        step(*strip)
        tracemalloc.start()
        step(*strip)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 0.75 * 4 * L.CLASSES * len(ids), step


def test_ids_kept_in_a_table_train_the_same_model(spark, monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["One two three. " * 30, "", "Zwei Wörter, four five " * 50, "x"]
    ids, sizes, _, _ = L.Lexicon(L._encoder(path), 50_256).read(texts)
    packed = L._packed(ids, sizes, 50_257)
    classes, _ = L.classes_of(np.bincount(ids, minlength=50_257), np.zeros(50_257, np.int64))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = spark.createDataFrame([(x,) for x in packed.to_pylist()], "ids binary").coalesce(1)
    want, got = (L.train(x, path, classes, 50_257, 50_256).matrix for x in (docs, rows))
    assert (want == got).all() and (want != L.Attention.start(50_257).matrix).any()
    for most in (1, 10, 400_000):
        monkeypatch.setattr(L, "_CHUNK_IDS", most)
        parts = list(L._unpacked(pa.record_batch([packed], ["ids"]).slice(1), 0, 50_257))
        assert np.concatenate([p[1] for p in parts]).tolist() == ids[sizes[0] :].tolist() and np.concatenate([p[2] for p in parts]).tolist() == sizes[1:].tolist()
        assert sum(p[0].num_rows for p in parts) == 3


def test_known_words_are_looked_up_once():
    hashed = []

    class Word(bytes):
        def __hash__(self):
            hashed.append(bytes(self))
            return bytes.__hash__(self)

    lexicon = L.Lexicon(L._encoder(JSON), 50_256)
    words = [b"one", b"two", b"one", b"three", b"two"]
    assert lexicon.numbers(words).tolist() == [1, 2, 1, 3, 2] and lexicon.names == [b"\xff", b"one", b"two", b"three"]
    assert lexicon.numbers([Word(w) for w in words[:3]]).tolist() == [1, 2, 1]
    assert hashed == words[:3]


def test_counts_of_words_that_are_given_out_in_parts(spark):
    n = 2 * L._COUNTED + 10
    half = " ".join(f"w{i}" for i in range(n))
    rows = [(half,), ("a A\tw5",), (None,), (half + " w7 w7",)]
    found = L.word_counts(spark.createDataFrame(rows, "text string").selectExpr("coalesce(text, '') AS text").coalesce(1))
    assert found.count() == n + 1
    few = {bytes(r["word"]): r["c"] for r in found.where("word IN (X'61', X'7735', X'7737', X'7739')").collect()}
    assert few == {b"a": 2, b"w5": 3, b"w7": 4, b"w9": 2} and found.groupBy().sum("c").first()[0] == 2 * n + 5


def test_subwords_are_counted_from_the_kept_ids(spark):
    ids, sizes, _, _ = L.Lexicon(L._encoder(JSON), 50_256).read(["One two two. " * 30, "", "Zwei Wörter", "x"])
    rows = spark.createDataFrame([(x,) for x in L._packed(ids, sizes, 50_257).to_pylist()], "ids binary")
    assert L.subword_counts(rows, 50_257).tolist() == np.bincount(ids, minlength=50_257).tolist()
    assert L.subword_counts(rows.limit(0), 50_257).tolist() == [0] * 50_257
