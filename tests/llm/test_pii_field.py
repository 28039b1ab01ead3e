"""The skip-chain field: training, what its edges add, and long tokens."""

import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq

from triplewright.llm import pii

TEXTS = [f"mail user{i}@host{i % 7}.example.com, call +1 (555) 123-{4000 + i} or go to 10.0.{i}.1 in {i} days, again user{i}@host{i % 7}.example.com; 4111-1111-1111-1111 or rev {i}.2" for i in range(200)]


def counted(texts):
    n = Counter()
    for x in texts:
        t = pii.tokens_of(x)
        n.update(pii.around(t, pii.labels_of(t, pii.base_spans(x))))
    return sorted((*k, v) for k, v in n.items())


def added(field, text):
    base = pii.base_spans(text)
    every = field.spans(text, base)
    assert set(base) <= set(every)
    return [text[a:b] for a, b, _ in every if (a, b, _) not in base]


def test_training_lowers_the_penalised_loss():
    counts = counted(TEXTS)
    n = Counter()
    for c in counts:
        n["token", c[0], c[1], 0] += c[8]
        for k, kind in enumerate(pii.EDGES):
            if c[2 + 2 * k] >= 0:
                n[kind, "", c[2 + 2 * k], c[1]] += c[8]
    start = pii.train(sorted((*k, v) for k, v in n.items()))
    trained = pii.refine(start, counts)
    hidden = [("", *c[1:]) for c in counts if max(c[4:8]) >= 0]
    weight = np.sqrt([c[8] for c in (*counts, *hidden)])

    def loss(f):
        own = -sum(w * pii.pseudo_likelihood(f, [c]) for w, c in zip(weight, (*counts, *hidden), strict=True)) / weight.sum()
        return own + pii.DECAY / 2 * ((f.weights**2).sum() + sum(((f.pair[k] - start.pair[k]) ** 2).sum() for k in pii.EDGES))

    assert loss(trained) < loss(start)
    assert pii.learn(counts).weights.tolist() == trained.weights.tolist()
    step = pii.refine(start, counts, rounds=1)  # a step in the weights or in one kind of pairs alone helps, too
    assert loss(replace(start, weights=step.weights)) < loss(start)
    for k in pii.EDGES:
        assert loss(replace(start, pair=start.pair | {k: step.pair[k]})) <= loss(start)


def test_spans_come_through_the_edges(monkeypatch):
    field = pii.learn(counted(pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").drop_null().to_pylist()))
    text = "see mary.jones@corp.example.org today; mary.jones@corp is the same as mary.jones@corp here"
    assert added(field, text) == ["mary.jones@corp", "mary.jones@corp"]
    far = "see mary.jones@corp.example.org today" + " and so on" * 5000 + " then mary.jones@corp"
    assert added(field, far) == ["mary.jones@corp"]
    like = "see mary.jones@corp.example.org today, or maryjones@corp"
    assert added(field, like) == ["maryjones@corp"]
    for alone in ("mary.jones@corp is here", "revision 12 of 2024, 3.5 or 10:30", "see a.b@c.example.org and other@place"):
        assert added(field, alone) == []
    tokens = pii.tokens_of
    monkeypatch.setattr(pii, "tokens_of", lambda x: replace(tokens(x), skip=[], similar=[]))
    assert added(field, text) == added(field, like) == []


def test_unlabelled_tokens_do_not_teach():
    text = "jo.mar@c.example.org and jo.mar@c or 12 of 34"
    t = pii.tokens_of(text)
    labels = pii.labels_of(t, pii.base_spans(text))
    assert labels == [1, 0, 0, 0] and t.tied(labels) == [{1}, {1}, set(), set()]
    rows = pii.around(t, labels)
    assert [r[1] for r in rows] == [1, 0, 0] and all(x == -1 for x in rows[0][4:])  # jo.mar@c is no row, and absent for its neighbour


def test_long_tokens_take_linear_time():
    field = pii.learn(counted(TEXTS))
    for text in ("x" * 1_000_000 + " 1", "1" * 1_000_000, "@" * 200_000, "a@" * 200_000, "1." * 300_000, "+1(" * 200_000, "-" * 1_000_000 + "1 "):
        began = time.time()
        base = pii.base_spans(text)
        pii.tokens_of(text)
        assert time.time() - began < 2.5, text[:5]
        assert set(base) <= set(field.spans(text, base))
