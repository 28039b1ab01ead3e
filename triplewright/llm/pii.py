"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Base spans are the leftmost non-overlapping matches of each kind that pass its check. The field works on the
tokens (runs without white space) that hold a digit or an at sign; every other token is fixed to "no entity",
so leaving it out changes nothing. Its potentials are

* for a token, a multinomial logistic model over the parts of its shape;
* for neighbouring tokens (chain), for successive tokens of one document with the same stem (skip: the digits of a
  number, the local part of an address) and for successive ones that are alike (similar: the same last seven
  digits, or the same letters before the at sign), a table of label pairs.

They are trained by pseudo-likelihood: of each token given the labels around it, with base spans as labels. A
token without a base span that is tied to one with it may be an entity that the patterns miss, so it counts as
unlabelled; the others that are tied train the pairs a second time with their shape hidden, as such entities
look unlike any that the patterns find. Training starts from the logistic model alone and the pointwise mutual information of label pairs.
Shapes and labels around a token are few, so only a table of counts over all documents reaches the driver.
Loopy belief propagation spreads labels along all edges, those of base spans being certain; a token that reaches ``ADD_AT`` for a kind, touches no base
span and is tied to a token of that kind, directly or through others, becomes a span, together with neighbours
of the same kind. Base spans always stay.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive;
of spans with one start, kinds go in the order listed; a very long text or token is read whole, in linear time;
repeated rows get equal rows; extra columns are ignored by ``find`` and kept by ``redact``; an empty table
gives an empty table, and without any entity to learn from the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
TOLERANCE = 1e-7  # of a log message
DAMPED_AFTER = 64  # rounds: later messages go half way, so that they do not swing
ADD_AT = 0.8
CLIP = 4.0
DECAY = 1e-3
CERTAIN = 50.0  # log odds of a base span's label
AGREE = 1.0  # prior count of equal labels at the ends of a skip edge

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"\S*+")
_EDGE = ".,;:!?\"'`*$%&#|<>[]{}="

Span = tuple[int, int, int]  # start, end, index into KINDS


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each at sign is tried once: the local part is the run before it, as far as the last match allows."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), 0
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def _is_ip(m: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    if not _ANY.search(text):
        return []
    found = list(_emails(text))
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _is_ip(m)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


@dataclass
class Tokens:
    """The tokens of a text that may be entities, without the punctuation around them."""

    start: list[int]
    end: list[int]
    shape: list[str]
    chain: list[tuple[int, int]]  # neighbours with nothing but white space and punctuation between
    skip: list[tuple[int, int]]  # successive tokens with the same stem
    similar: list[tuple[int, int]] = field(default_factory=list)  # and with like ones

    def tied(self, labelled: list[int]) -> list[set[int]]:
        """For each token the labels (but 0) of the tokens that it reaches by skip and similar edges."""
        up = list(range(len(self.start)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in [*self.skip, *self.similar]:
            up[root(a)] = root(b)
        found: dict[int, set[int]] = {}
        for i, label in enumerate(labelled):
            found.setdefault(root(i), set()).update({label} - {0})
        return [found[root(i)] for i in range(len(up))]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def shape_of(token: str) -> str:
    """The parts of a token's shape, one character each: what it holds, and how much of it."""
    digits = sum(c.isdigit() for c in token)
    parts = (
        min(token.count("@"), 2), token[:1] == "+", min(token.count("."), 4), _bucket(digits, (1, 2, 4, 7, 10, 13, 14, 20)),
        any(c.isalpha() for c in token), "(" in token or ")" in token, "-" in token, _bucket(len(token), (2, 4, 7, 12, 16, 20, 30)),
        digits * 2 > len(token), "." in token.rpartition("@")[2],
    )
    return "".join(str(int(p)) for p in parts)


def _runs(text: str) -> Iterator[tuple[int, str]]:
    """Start and characters of each run without white space that holds a digit or an at sign, in linear time."""
    end = 0
    while m := _ANY.search(text, end):
        at = m.start()
        while at > end and not text[at - 1].isspace():
            at -= 1
        end = _REST.match(text, m.start()).end()
        yield at, text[at:end]


def tokens_of(text: str) -> Tokens:
    out, last, seen, alike = Tokens([], [], [], [], []), -1, {}, {}
    for at, raw in _runs(text):
        token = raw.strip(_EDGE)
        if not token:
            continue
        start = at + raw.index(token)
        i = len(out.start)
        out.start.append(start)
        out.end.append(start + len(token))
        out.shape.append(shape_of(token))
        if last >= 0 and not text[last:at].strip():
            out.chain.append((i - 1, i))
        last = at + len(raw)
        stem = token.partition("@")[0].lower() if "@" in token else "".join(c for c in token if c.isdigit())
        if len(stem) >= 4:
            if stem in seen:
                out.skip.append((seen[stem], i))
            seen[stem] = i
            kin = "".join(filter(str.isalpha, stem.partition("+")[0])) if "@" in token else stem[-7:] if len(stem) >= 7 else ""
            if len(kin) >= 4:
                if kin in alike and alike[kin] != (out.skip[-1][0] if out.skip and out.skip[-1][1] == i else -1):
                    out.similar.append((alike[kin], i))
                alike[kin] = i
    return out


def labels_of(tokens: Tokens, spans: list[Span]) -> list[int]:
    """Index into LABELS of each token: the kind of the first base span that it touches, else 0."""
    out, k = [0] * len(tokens.start), 0
    for i, (start, end) in enumerate(zip(tokens.start, tokens.end, strict=True)):
        while k < len(spans) and spans[k][1] <= start and spans[k][0] <= start:
            k += 1
        for s in spans[max(0, k - 4) : k + 8]:
            if s[0] < end and s[1] > start:
                out[i] = 1 + s[2]
                break
    return out


EDGES = ("chain", "skip", "similar")


@dataclass
class Field:
    parts: list[str]  # position and character of each one-hot part of a shape
    weights: np.ndarray  # (parts + 1, labels)
    pair: dict[str, np.ndarray]  # potentials of each kind of edge, (labels, labels)

    def unary(self, shapes: list[str]) -> np.ndarray:
        x = _one_hot(shapes, self.parts) @ self.weights
        return x - np.logaddexp.reduce(x, axis=1, keepdims=True)

    def marginals(self, tokens: Tokens, given: list[int] | None = None) -> np.ndarray:
        """Label probabilities by sum-product messages along all edges, passed until none changes by
        more than ``TOLERANCE``; without that, the rounds end at twice the tokens and 1000 more.

        ``given``: labels that are certain, 0 where none is.
        """
        unary = self.unary(tokens.shape)
        for i, label in enumerate(given or ()):
            if label:
                unary[i] = np.where(np.arange(len(LABELS)) == label, 0.0, -CERTAIN)
        edges = [(a, b, self.pair[k]) for k in EDGES for a, b in getattr(tokens, k)]
        if edges:
            a, b = np.array([e[:2] for e in edges]).T
            psi = np.stack([e[2] for e in edges])
            forward = backward = np.zeros((len(edges), len(LABELS)))
            for turn in range(2 * len(unary) + 1000):
                belief = unary.copy()
                np.add.at(belief, b, forward)
                np.add.at(belief, a, backward)
                new_f = np.logaddexp.reduce((belief[a] - backward)[:, :, None] + psi, axis=1)
                new_b = np.logaddexp.reduce((belief[b] - forward)[:, None, :] + psi, axis=2)
                new_f -= np.logaddexp.reduce(new_f, axis=1, keepdims=True)
                new_b -= np.logaddexp.reduce(new_b, axis=1, keepdims=True)
                change = max(np.abs(new_f - forward).max(), np.abs(new_b - backward).max())
                if turn >= DAMPED_AFTER:
                    new_f, new_b = (new_f + forward) / 2, (new_b + backward) / 2
                forward, backward = new_f, new_b
                if change < TOLERANCE:
                    break
            np.add.at(unary, b, forward)
            np.add.at(unary, a, backward)
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and the ones that the field adds."""
        tokens = tokens_of(text)
        if not tokens.start or len(self.weights) < 2:
            return base
        touched = labels_of(tokens, base)
        p = self.marginals(tokens, touched)
        best = p.argmax(1)
        tied = tokens.tied(touched)
        added: list[Span] = []
        joined = {b for a, b in tokens.chain}
        for i in np.flatnonzero((best > 0) & (p.max(1) >= ADD_AT)):
            if touched[i] or best[i] not in tied[i]:
                continue
            kind = int(best[i]) - 1
            if added and i in joined and added[-1][2] == kind and added[-1][1] == tokens.end[i - 1]:
                added[-1] = (added[-1][0], tokens.end[i], kind)
            else:
                added.append((tokens.start[i], tokens.end[i], kind))
        return sorted(base + added, key=lambda s: (s[0], s[2]))


def _one_hot(shapes: list[str], parts: list[str]) -> np.ndarray:
    at = {p: i for i, p in enumerate(parts)}
    x = np.zeros((len(shapes), len(parts) + 1))
    x[:, -1] = 1
    for r, shape in enumerate(shapes):
        for k, c in enumerate(shape):
            if (i := at.get(f"{k}{c}")) is not None:
                x[r, i] = 1
    return x


def train(counts: list[tuple[str, str, int, int, int]]) -> Field:
    """A field from counts (what, shape, label, other label, n) that are taken as independent; what: token or a kind of edge."""
    shapes = sorted({c[1] for c in counts if c[0] == "token"})
    parts = sorted({f"{k}{c}" for s in shapes for k, c in enumerate(s)})
    y = np.zeros((len(shapes), len(LABELS)))
    row = {s: i for i, s in enumerate(shapes)}
    pair = {k: np.zeros((len(LABELS), len(LABELS))) for k in EDGES}
    for what, shape, a, b, n in counts:
        if what == "token":
            y[row[shape], a] += n
        else:
            pair[what][a, b] += n
    weights = np.zeros((len(parts) + 1 if shapes and y[:, 1:].sum() else 1, len(LABELS)))
    if len(weights) > 1:
        x, weight = _one_hot(shapes, parts), np.sqrt(y.sum(1, keepdims=True))  # frequent shapes count more, but less than in proportion
        goal, weight = y / y.sum(1, keepdims=True), weight / weight.sum()
        velocity = np.zeros_like(weights)
        for _ in range(1500):
            z = x @ weights
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            velocity = 0.9 * velocity - 0.5 * (x.T @ (weight * (p - goal)) + 1e-4 * weights)
            weights = weights + velocity
    for k, n in pair.items():
        n = n + 0.1 + AGREE * (k != "chain") * np.eye(len(LABELS))
        expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
        pair[k] = np.clip(np.log(n / expected), -CLIP, CLIP)
    return Field(parts, weights, pair)


Around = tuple[str, int, int, int, int, int, int, int]  # shape, label, labels before and after by each kind of edge (-1: none)


def around(tokens: Tokens, labels: list[int]) -> list[Around]:
    """Each labelled token with the labels around it. Unlabelled ones (see the module's text) count as absent."""
    unknown = [not label and bool(kin) for label, kin in zip(labels, tokens.tied(labels), strict=True)]
    near = [[-1] * (2 * len(EDGES)) for _ in labels]
    for k, kind in enumerate(EDGES):
        for a, b in getattr(tokens, kind):
            near[b][2 * k] = -1 if unknown[a] else labels[a]
            near[a][2 * k + 1] = -1 if unknown[b] else labels[b]
    return [(s, label, *n) for s, label, n, u in zip(tokens.shape, labels, near, unknown, strict=True) if not u]


def _scores(x: np.ndarray, near: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> np.ndarray:
    z = x @ weights
    for k in range(len(EDGES)):
        z = z + np.vstack([pair[k], np.zeros(len(LABELS))])[near[:, 2 * k]] + np.vstack([pair[k].T, np.zeros(len(LABELS))])[near[:, 2 * k + 1]]
    return z


def pseudo_likelihood(field_: Field, counts: list[tuple]) -> float:
    """Mean log probability of each token's label given those around it; ``counts``: rows of :func:`around` with their number."""
    x, near = _one_hot([c[0] for c in counts], field_.parts), np.array([c[2:8] for c in counts])
    z = _scores(x, near, field_.weights, np.stack([field_.pair[k] for k in EDGES]))
    z -= np.logaddexp.reduce(z, axis=1, keepdims=True)
    n = np.array([c[8] for c in counts], float)
    return float((z[np.arange(len(counts)), [c[1] for c in counts]] * n).sum() / n.sum())


def refine(start: Field, counts: list[tuple], rounds: int = 600) -> Field:
    """``start`` trained further by pseudo-likelihood on rows of :func:`around` with their number."""
    if len(start.weights) < 2 or not counts:
        return start
    counts = [*counts, *(("", *c[1:]) for c in counts if max(c[4:8]) >= 0)]  # tied tokens also with their shape hidden
    x, near = _one_hot([c[0] for c in counts], start.parts), np.array([c[2:8] for c in counts])
    goal = np.eye(len(LABELS))[[c[1] for c in counts]]
    weight = np.sqrt(np.array([[c[8]] for c in counts], float))
    weight /= weight.sum()
    weights, pair = start.weights.copy(), np.stack([start.pair[k] for k in EDGES])
    first, speed, speeds = pair.copy(), np.zeros_like(weights), np.zeros_like(pair)
    for _ in range(rounds):
        z = _scores(x, near, weights, pair)
        error = weight * (np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True)) - goal)
        speed = 0.9 * speed - 0.5 * (x.T @ error + DECAY * weights)
        g = np.zeros_like(pair)
        for k in range(len(EDGES)):
            before, after = near[:, 2 * k], near[:, 2 * k + 1]
            np.add.at(g[k], before[before >= 0], error[before >= 0])
            np.add.at(g[k].T, after[after >= 0], error[after >= 0])
        speeds = 0.9 * speeds - 0.5 * (g + DECAY * (pair - first))  # pairs that are rare stay near where they start
        weights, pair = weights + speed, np.clip(pair + speeds, -CLIP, CLIP)
    return Field(start.parts, weights, dict(zip(EDGES, pair, strict=True)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text and _ANY.search(text):
                t = tokens_of(text)
                n.update(around(t, labels_of(t, base_spans(text))))
    if n:
        cols = list(zip(*n, strict=True))
        yield pa.record_batch([pa.array(cols[0]), *(pa.array(c, pa.int32()) for c in cols[1:]), pa.array(list(n.values()), pa.int64())], [*_AROUND, "n"])


_AROUND = ("shape", "label", *(f"{k}_{side}" for k in EDGES for side in ("before", "after")))


def learn(counts: list[tuple]) -> Field:
    """A field from rows of :func:`around` with their number."""
    n: Counter = Counter()
    for c in counts:
        n["token", c[0], c[1], 0] += c[8]
        for k, kind in enumerate(EDGES):
            if c[2 + 2 * k] >= 0:
                n[kind, "", c[2 + 2 * k], c[1]] += c[8]
    return refine(train(sorted((*k, v) for k, v in n.items())), counts)


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """A field from the counts of all documents; at most some thousand rows of counts reach the driver."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "shape string, " + ", ".join(f"{c} int" for c in _AROUND[1:]) + ", n long")
    return learn(sorted(tuple(r) for r in counted.groupBy(*_AROUND).agg(F.sum("n").alias("n")).collect()))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, at, runs = [], 0, []
    for start, end, kind in spans:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end, kind])
    for start, end, kind in runs:
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base_spans and spans (text form), n_<kind> of base spans, masked text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                counts, digests, spans, texts = [], [], [], []
                for t in part.column(1).to_pylist():
                    base = base_spans(t) if t else []
                    every = shared.value.spans(t, base) if t and _ANY.search(t) else []
                    counts.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else empty)
                    spans.append(written(every))
                    texts.append(masked(t, every) if every else t)
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in np.array(counts).reshape(-1, len(KINDS)).T), pa.array(digests), pa.array(spans), pa.array(texts, pa.string())], names)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {id_type}, {counts}, base_sha256 string, spans string, masked string")


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked in ``text_col``; ``length_col``, where there is one, follows the new text."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, shared.value.spans(t, base_spans(t))) if t and _ANY.search(t) else t for t in b.column(at).to_pylist()]
            columns = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]]
            yield pa.record_batch(columns, b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns and isinstance(docs.schema[length_col].dataType, (T.IntegerType, T.LongType)):
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
