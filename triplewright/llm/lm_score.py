"""Language-model scores: a causal self-attention model in numpy on subword ids, beside a unigram base.

Tokens of the base are lower-cased words and one end per text. Its counts cover all training texts: words are
counted in every partition and combined by a shuffle. Of the counts, up to ``FREQUENT_WORDS`` of the largest go to all
tasks; occurrences of other words are joined with the full table by shuffle.

The model reads subword ids. The next id's probability is that of its class, given by one causal attention
layer over the window, times its share of the class's count over all training texts. It reads a text as its
lower-cased words with one blank before each, and that form is what it gives the probability of. Texts are scored in
windows of ``WINDOW`` inputs that overlap by half; each id is scored once, with at least half a window of
context where the text has it. Each text is turned into ids once; a table keeps them for the counts of ids, training and scoring. Training
runs on the executors, ``EPOCHS`` times over all training texts, on the same windows over every id of each text and
its end: each task trains from the common parameters, in steps of
``BATCH`` windows, and the changes are averaged, row by row of the parameter matrix, by an aggregation.

Defined results: a null text counts as empty and has one token, its end; rows that repeat an id and a text
get equal rows; words of no letters are words like others; of words and ids of equal count the lesser id comes first
in the classes; a very long text is scored whole, window by window; without training texts all counts are 0 and the
model is its random start; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.llm.common import materialize, whole
from triplewright.llm.packing import in_chunks
from triplewright.llm.token_ids import TextEncoder

WINDOW = 32
DIM = 16
CLASSES = 64
EPOCHS = 1
BATCH = 128  # windows of a training step
RATE = 0.1
FREQUENT_WORDS = 200_000
_COUNTED = 300_000
_LEXICON = 300_000
_CHUNK_CHARS = 2_000_000
_CHUNK_IDS = 400_000
_STEP = WINDOW // 2
_SCORED_AT_ONCE = 128  # windows, so that their arrays stay in the cache
_MOST = 60.0  # of an exponent


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def split(data: bytes) -> pa.Array:
    """As ``data.split()``, without an object per word."""
    if not data:
        return pa.array([], pa.large_binary())
    at = np.frombuffer(data, np.uint8)
    blank = _BLANK[at]
    held = np.concatenate([[True], blank, [True]])
    edges = np.flatnonzero(held[1:] != held[:-1])  # starts and ends of words, in turn
    offsets = np.concatenate([[0], (edges[1::2] - edges[::2]).cumsum()])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(at[~blank])])


class Numbers:
    """Numbers of words, from 0 in the order of their first look-up."""

    def __init__(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)

    def __len__(self) -> int:
        return len(self.index)

    def of(self, words: list[bytes]) -> np.ndarray:
        """One look-up per word; it gives new ones the next number."""
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def since(self, known: int) -> list[bytes]:
        """The words from number ``known`` on, in order."""
        return list(islice(reversed(self.index), len(self.index) - known))[::-1]


# --- counts -----------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over all texts of ``training``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n = Numbers(), np.zeros(0, np.int64)
        for b in batches:
            for _, texts in in_chunks(b, 0, _CHUNK_CHARS):
                words, times = split(" ".join(texts).encode().lower()).value_counts().flatten()
                at = numbers.of(words.to_numpy(zero_copy_only=False).tolist())
                n = np.concatenate([n, np.zeros(len(numbers) - len(n), np.int64)])
                n[at] += times.to_numpy()
                if len(n) > _COUNTED:
                    yield pa.record_batch([pa.array(numbers.since(0), pa.binary()), pa.array(n)], ["word", "c"])
                    numbers, n = Numbers(), np.zeros(0, np.int64)
        if len(n):
            yield pa.record_batch([pa.array(numbers.since(0), pa.binary()), pa.array(n)], ["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def subwords(encoder: TextEncoder, words: list[bytes]) -> np.ndarray:
    """Ids of the words, each with a blank before it."""
    return np.frombuffer(encoder.encode([(b" " + b" ".join(words)).decode()])[0], "<u4").astype(np.int64) if words else np.zeros(0, np.int64)


_END = b"\xff"  # in no word of a text: UTF-8 has no such byte


class Lexicon:
    """Subword ids of the words of a Python worker, each distinct word encoded once (a bounded number of them is kept),
    and a number for each word that ``logs`` knows."""

    def __init__(self, encoder: TextEncoder, end_id: int, logs: dict[bytes, float] | None = None, most: int = _LEXICON):
        self.encoder, self.end_id, self.logs, self.most = encoder, end_id, logs or {}, most
        self.starts = np.array([encoder.engine.decode_single_token_bytes(i)[:1] == b" " for i in range(encoder.engine.max_token_value + 1)], np.int64)
        self.clear()

    def clear(self) -> None:
        """Number 0 is the end of a text."""
        self.index = Numbers()
        self.index.of([_END])
        self.names: list[bytes] = [_END]
        self.pool, self.at, self.size = np.array([self.end_id], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.log = np.zeros(1)

    def numbers(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        if isinstance(words, pa.Array):  # each distinct word is looked up once
            kinds = words.dictionary_encode()
            return self.numbers(kinds.dictionary.to_numpy(zero_copy_only=False).tolist())[kinds.indices.to_numpy()]
        out = self.index.of(words)
        if new := self.index.since(len(self.names)):
            self.names += new
            ids = subwords(self.encoder, new)
            owner = np.cumsum(self.starts[ids]) - 1  # a token that starts with a blank starts a word
            if owner[-1] == len(new) - 1:
                size = np.bincount(owner, minlength=len(new))
            else:
                parts = [subwords(self.encoder, [w]) for w in new]
                ids, size = np.concatenate(parts), np.array([len(x) for x in parts])
            self.at = np.concatenate([self.at, len(self.pool) + size.cumsum() - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids.astype(np.int32)])
            self.log = np.concatenate([self.log, np.fromiter(map(self.logs.get, new, repeat(np.nan)), float, len(new)) if self.logs else np.full(len(new), np.nan)])
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with its end; ids per text; numbers of the words with the ends; words per text."""
        if len(self.names) > self.most:
            self.clear()
        numbers = self.numbers(split(b"".join([t.encode() + b" " + _END + b" " for t in texts]).lower()))
        counts = np.diff(np.flatnonzero(numbers == 0), prepend=-1)
        size = self.size[numbers]
        to = size.cumsum()
        ids = self.pool[np.repeat(self.at[numbers] - to + size, size) + np.arange(to[-1] if len(to) else 0)]
        return ids, np.add.reduceat(size, counts.cumsum() - counts), numbers, counts


_LEXICONS: dict[tuple[str, int], Lexicon] = {}


def _lexicon(path: str, end_id: int) -> Lexicon:
    """A lexicon without logs that the tasks of a worker share: the words that they have seen stay."""
    if (path, end_id) not in _LEXICONS:
        _LEXICONS[path, end_id] = Lexicon(_encoder(path), end_id)
    return _LEXICONS[path, end_id]


def subword_counts(training: DataFrame, vocabulary: int) -> np.ndarray:
    """Count of each subword id over all training texts, from their ids (see :func:`_packed`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for _, ids, _ in _unpacked(b, 0, vocabulary):
                n += np.bincount(ids, minlength=vocabulary)
        ids = np.flatnonzero(n)
        yield pa.record_batch([pa.array(ids), pa.array(n[ids])], ["id", "n"])

    found = training.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id
    out = np.zeros(vocabulary, np.int64)
    out[found["id"]] = found["n"]
    return out


def classes_of(counts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and log10 of its share in the class.

    The most frequent ids are classes of their own; the others, ordered by kind and count, are cut into
    classes of about equal mass.
    """
    mass = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts))
    single, rest = order[: CLASSES // 2], order[CLASSES // 2 :]
    rest = rest[np.argsort(kinds[rest], kind="stable")]
    share = mass[rest].cumsum() / mass[rest].sum()
    out = np.zeros(len(counts), np.int64)
    out[single] = np.arange(len(single))
    out[rest] = CLASSES // 2 + np.minimum((share * (CLASSES - CLASSES // 2)).astype(np.int64), CLASSES - CLASSES // 2 - 1)
    total = np.bincount(out, mass, CLASSES)
    return out, np.log10(mass / total[out])


# --- the model --------------------------------------------------------------


@dataclass
class Attention:
    """All parameters are rows of one (rows, DIM) matrix: embeddings, then the dense ones (see ``dense``)."""

    matrix: np.ndarray
    vocabulary: int

    @classmethod
    def start(cls, vocabulary: int) -> Attention:
        rows = vocabulary + 1 + 3 * DIM + 2 * CLASSES + (CLASSES + WINDOW) // DIM
        return cls(np.random.default_rng(11).normal(0, 0.1, (rows, DIM)).astype(np.float32), vocabulary)

    def dense(self, matrix: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Views of the dense parameters: they share memory with the matrix."""
        m, at, out = self.matrix if matrix is None else matrix, self.vocabulary + 1, {}
        for name, rows in (("query", DIM), ("key", DIM), ("value", DIM), ("out", CLASSES), ("skip", CLASSES), ("bias", CLASSES // DIM), ("near", WINDOW // DIM)):
            out[name] = m[at : at + rows]
            at += rows
        return out


#: How far back each input of a window is from each scored position, and whether it is visible.
_BACK = _STEP + np.arange(_STEP)[:, None] - np.arange(WINDOW)[None, :]
_SEEN = _BACK >= 0


def windows_of(ids: np.ndarray, padding: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW) and targets (n, _STEP) over a text's ids; -1 pads the targets."""
    blocks, targets = strip_of(ids, np.array([len(ids)]), padding, begin)
    return np.concatenate([blocks[:-1], blocks[1:]], 1), targets


def strip_of(ids: np.ndarray, sizes: np.ndarray, padding: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' windows as one strip, given their ids end to end: blocks (n + 1, _STEP) of inputs and targets (n, _STEP).

    Window i is blocks i and i + 1; its targets belong to the second. Each text has a block of padding, then
    its inputs from ``begin`` on. Windows that end in a block of padding have no targets (-1).
    """
    count = -(-sizes // _STEP) + 1
    first = (count.cumsum() - count + 1) * _STEP
    at = np.repeat(first - (sizes.cumsum() - sizes), sizes) + np.arange(len(ids))
    inputs, targets = np.full(count.sum() * _STEP, padding, np.int32), np.full(count.sum() * _STEP, -1, np.int32)
    targets[at] = ids
    inner = np.ones(len(ids), bool)
    inner[sizes.cumsum()[sizes > 0] - 1] = False
    inputs[at[inner] + 1] = ids[inner]
    inputs[first[sizes > 0]] = begin
    return inputs.reshape(-1, _STEP), targets.reshape(-1, _STEP)[1:]


def _apart(inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Any windows as a strip: between two of them is one without targets."""
    blocks = inputs.reshape(-1, _STEP)
    out = np.full((len(blocks) - 1, _STEP), -1, np.int64)
    out[::2] = targets
    return blocks, out


def _in_windows(rows: np.ndarray) -> np.ndarray:
    """(n + 1, _STEP, columns) by block, without gaps, as an overlapping view (n, WINDOW, columns)."""
    return np.ndarray((len(rows) - 1, WINDOW, rows.shape[2]), rows.dtype, rows, 0, rows.strides)


_PLACE = np.clip(_BACK, 0, WINDOW - 1)


def _bias(near: np.ndarray) -> np.ndarray:
    return np.where(_SEEN, near[_PLACE], near.dtype.type(-1e9))


def _exp(x: np.ndarray) -> np.ndarray:
    """exp of ``x``, at most ``_MOST``, in its place."""
    if x.max(initial=0) > _MOST:
        np.minimum(x, _MOST, out=x)
    return np.exp(x, out=x)


def _attend(query: np.ndarray, key: np.ndarray, bias: np.ndarray, padded: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Unnormalised attention of each scored position to the inputs of its window, exp(scores), 0 where hidden; in ``out``."""
    scores = np.matmul(query, key.transpose(0, 2, 1), out=out)
    scores += bias
    scores[padded, :, :_STEP] = -1e9  # the first block of these windows is padding
    return _exp(scores)


class _Room:
    """Arrays that are used again by each step, so that their memory stays in the cache."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype, fill: float | None = None) -> np.ndarray:
        """With ``fill`` in all of it when it is new."""
        found = self.held.get(name)
        if found is None or found.shape != shape or found.dtype != dtype:
            self.held[name] = found = np.empty(shape, dtype) if fill is None else np.full(shape, fill, dtype)
        return found


class Scorer:
    def __init__(self, model: Attention, classes: np.ndarray, within: np.ndarray):
        d, e = model.dense(), model.matrix[: model.vocabulary + 1]
        one = np.ones((len(e), 1), e.dtype)
        self.table = np.concatenate([e @ d["query"] / e.dtype.type(DIM**0.5), e @ d["key"], e @ d["value"], one], 1)  # by id
        self.skip = e @ d["skip"].T + d["bias"].reshape(-1)
        self.out, self.bias = np.ascontiguousarray(d["out"].T), _bias(d["near"].reshape(-1))
        self.classes, self.within, self.padding = classes, within, model.vocabulary
        self.room, self.ones, self.first = _Room(), np.ones(CLASSES, e.dtype), np.arange(_SCORED_AT_ONCE * _STEP) * CLASSES

    def strip(self, blocks: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probabilities (n, _STEP) of the targets; 0 where there is none."""
        out, kind = np.zeros(targets.shape), self.table.dtype
        for at in range(0, len(targets), _SCORED_AT_ONCE):
            part, goal = blocks[at : at + _SCORED_AT_ONCE + 1], targets[at : at + _SCORED_AT_ONCE].reshape(-1)
            n, ids = len(part) - 1, part.reshape(-1)
            rows = np.take(self.table, ids, 0, out=self.room("rows", (len(ids), self.table.shape[1]), kind), mode="clip").reshape(n + 1, _STEP, -1)
            seen = _in_windows(rows)
            weights = _attend(rows[1:, :, :DIM], seen[:, :, DIM : 2 * DIM], self.bias, part[:-1, 0] == self.padding, self.room("weights", (n, _STEP, WINDOW), kind))
            mixed = np.matmul(weights, seen[:, :, 2 * DIM :], out=self.room("mixed", (n, _STEP, DIM + 1), kind)).reshape(-1, DIM + 1)  # the last column is the sum of the weights
            mixed = np.multiply(mixed[:, :DIM], 1 / mixed[:, DIM:], out=self.room("mean", (len(goal), DIM), kind))
            logits = np.matmul(mixed, self.out, out=self.room("logits", (len(goal), CLASSES), kind))
            logits += np.take(self.skip, ids[_STEP:], 0, out=self.room("skip", logits.shape, kind), mode="clip")
            picked = logits.reshape(-1)[self.first[: len(goal)] + self.classes[goal]].astype(float)
            picked -= np.log(_exp(logits) @ self.ones)
            out[at : at + _SCORED_AT_ONCE] = np.where(goal >= 0, picked / np.log(10) + self.within[goal], 0.0).reshape(-1, _STEP)
        return out

    def log10(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The same for any windows, inputs (n, WINDOW)."""
        return self.strip(*_apart(inputs, targets))[::2]

    def score(self, ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
        """log10 probability of each text's ids, given end to end; each text has one at least."""
        blocks, targets = strip_of(ids, sizes, self.padding, begin)
        found, count = np.concatenate([[0.0], self.strip(blocks, targets).sum(1)]), -(-sizes // _STEP) + 1
        return np.add.reduceat(found, count.cumsum() - count)


class Trainer:
    """Adagrad on batches of windows, with the gradients written out."""

    def __init__(self, model: Attention, classes: np.ndarray):
        self.m, self.classes = model, classes
        self.seen = np.zeros(len(model.matrix), np.int64)
        self.squares = np.full_like(model.matrix, 1e-2)
        self.room = _Room()

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> float:
        """One step on any windows; the mean loss of their targets before it."""
        return self.strip(*_apart(inputs, targets))

    def strip(self, blocks: np.ndarray, targets: np.ndarray) -> float:
        """One step on a strip of windows (see :func:`strip_of`)."""
        m, d, n, kind = self.m, self.m.dense(), len(targets), self.m.matrix.dtype
        scale, room, ids, size = kind.type(DIM**-0.5), self.room, blocks.reshape(-1), n * _STEP
        into = np.concatenate([d["query"] * scale, d["key"], d["value"]], 1)  # (DIM, 3 DIM)
        e = np.take(m.matrix, ids, 0, out=room("e", (len(ids), DIM), kind), mode="clip")
        rows = np.matmul(e, into, out=room("rows", (len(ids), 3 * DIM), kind)).reshape(n + 1, _STEP, 3 * DIM)
        seen = _in_windows(rows)
        q, k, v = rows[1:, :, :DIM], seen[:, :, DIM : 2 * DIM], seen[:, :, 2 * DIM :]
        w = _attend(q, k, _bias(d["near"].reshape(-1)), blocks[:-1, 0] == m.vocabulary, room("w", (n, _STEP, WINDOW), kind))
        w *= (1 / (w.reshape(size, WINDOW) @ np.ones(WINDOW, kind))).reshape(n, _STEP, 1)
        x = room("x", (size, 2 * DIM + 1), kind, 1.0)  # the mix, the input itself, and 1 for the bias
        np.matmul(w, v, out=x.reshape(n, _STEP, -1)[:, :, :DIM])
        x[:, DIM:-1] = e[_STEP:]
        z = np.matmul(x, np.concatenate([d["out"], d["skip"], d["bias"].reshape(-1, 1)], 1).T, out=room("z", (size, CLASSES), kind))
        dz, goal = _exp(z), targets.reshape(-1)
        real, total = goal >= 0, dz @ np.ones(CLASSES, kind)
        count, at = max(1, int(np.count_nonzero(real))), np.arange(0, size * CLASSES, CLASSES) + self.classes[goal]
        flat = dz.reshape(-1)
        loss = -float(np.log(flat[at] / total + 1e-12) @ real) / count
        share = real * kind.type(1 / count)
        dz *= (share / total)[:, None]
        flat[at] -= share
        g_dense = dz.T @ x
        dx = np.matmul(dz, np.concatenate([d["out"], d["skip"]], 1), out=room("dx", (size, 2 * DIM), kind))  # to the mix and to the input itself
        da = dx[:, :DIM].reshape(n, _STEP, DIM)
        dw = np.matmul(da, v.transpose(0, 2, 1), out=room("dw", w.shape, kind))
        dw -= np.einsum("ij,ij->i", dx[:, :DIM], x[:, :DIM]).reshape(n, _STEP, 1)
        dw *= w
        d_rows = room("d_rows", rows.shape, kind, 0.0)  # to queries, of which the first block has none, keys and values
        np.matmul(dw, k, out=d_rows[1:, :, :DIM])
        each_window = room("each_window", (n, WINDOW, 2 * DIM), kind)  # to keys and values; an input is in two windows
        np.matmul(dw.transpose(0, 2, 1), q, out=each_window[:, :, :DIM])
        np.matmul(w.transpose(0, 2, 1), da, out=each_window[:, :, DIM:])
        dkv = d_rows[:, :, DIM:]
        dkv[0] = each_window[0, :_STEP]
        np.add(each_window[1:, :_STEP], each_window[:-1, _STEP:], out=dkv[1:-1])
        dkv[-1] = each_window[-1, _STEP:]
        d_rows = d_rows.reshape(-1, 3 * DIM)
        de = np.matmul(d_rows, into.T, out=room("de", e.shape, kind))
        de[_STEP:] += dx[:, DIM:]
        into_g = (d_rows.T @ e).T
        by_back = np.bincount(_PLACE.reshape(-1), (np.ones(n, kind) @ dw.reshape(n, -1)) * _SEEN.reshape(-1), WINDOW)
        dense = np.concatenate([into_g[:, :DIM] * scale, into_g[:, DIM : 2 * DIM], into_g[:, 2 * DIM :], g_dense[:, :DIM], g_dense[:, DIM : 2 * DIM], g_dense[:, -1].reshape(-1, DIM), by_back.reshape(-1, DIM).astype(kind)])

        order = np.argsort(ids.astype(np.uint16) if m.vocabulary < 1 << 16 else ids, kind="stable")
        sorted_ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        found, sums = sorted_ids[first], np.add.reduceat(np.take(de, order, 0, out=room("sorted", de.shape, kind), mode="clip"), first, 0)
        if found[-1] == m.vocabulary:  # padding, the largest
            found, sums = found[:-1], sums[:-1]
        touched = np.concatenate([found, np.arange(m.vocabulary + 1, len(m.matrix))])
        grad = np.concatenate([sums, dense])
        self.seen[touched] += 1
        squares = np.take(self.squares, touched, 0)
        squares += grad * grad
        self.squares[touched] = squares
        grad *= RATE
        grad /= np.sqrt(squares, out=squares)
        m.matrix[touched] = np.take(m.matrix, touched, 0) - grad
        return loss


def _packed(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> pa.Array:
    """The ids of each text as little-endian integers, of two bytes if the vocabulary allows."""
    flat = ids.astype("<u2" if vocabulary <= 1 << 16 else "<u4")
    offsets = np.concatenate([[0], sizes.cumsum()]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(batch: pa.RecordBatch, column: int, vocabulary: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' ids end to end and ids per text, each of about ``_CHUNK_IDS`` ids."""
    kind, found = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4"), batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] // kind.itemsize
    flat = np.frombuffer(found.buffers()[2], kind)
    start = 0
    while start < len(found):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _CHUNK_IDS, "right")) - 1)
        yield batch.slice(start, end - start), flat[offsets[start] : offsets[end]].astype(np.int32), np.diff(offsets[start : end + 1])
        start = end


def train(training: DataFrame, path: str, classes: np.ndarray, vocabulary: int, begin: int) -> Attention:
    """Averaged training: every training text takes part in each of the ``EPOCHS`` rounds. ``training`` has the texts (text)
    or, if they have been read already, their ids (ids; see :func:`_packed`)."""
    column = "ids" if "ids" in training.columns else "text"
    model = Attention.start(vocabulary)
    spark = training.sparkSession
    columns = [f"v{k}" for k in range(DIM)]
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast((model.matrix, classes))  # about 4 MB, fixed by the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matrix, classes = shared.value
            t = Trainer(Attention(matrix.copy(), vocabulary), classes)
            blocks, targets = np.zeros((0, _STEP), np.int32), np.zeros((0, _STEP), np.int32)

            def read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                if column == "ids":
                    yield from (x[1:] for x in _unpacked(b, 0, vocabulary))
                else:
                    yield from (_lexicon(path, begin).read(texts)[:2] for _, texts in in_chunks(b, 0, _CHUNK_CHARS))

            for b in batches:
                for ids, sizes in read(b):
                    more, goals = strip_of(ids, sizes, vocabulary, begin)
                    at = 0
                    if len(blocks):  # what the last texts left over, then a window without targets
                        goals = np.concatenate([targets, np.full((1, _STEP), -1, np.int32), goals])
                        more = np.concatenate([blocks, more])
                    while len(goals) - at >= BATCH:
                        t.strip(more[at : at + BATCH + 1], goals[at : at + BATCH])
                        at += BATCH
                    blocks, targets = more[at:], goals[at:]
            if len(targets):
                t.strip(blocks, targets)
            rows = np.flatnonzero(t.seen)
            change = (t.m.matrix[rows] - matrix[rows]).astype(np.float64) * t.seen[rows, None]
            yield pa.record_batch([pa.array(rows), pa.array(t.seen[rows]), *map(pa.array, change.T)], ["row", "n", *columns])

        schema = "row long, n long, " + ", ".join(f"{c} double" for c in columns)
        found = training.select(column).mapInArrow(run, schema).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toPandas()  # at most one row per parameter row
        matrix = model.matrix.copy()
        matrix[found["row"].to_numpy(np.int64)] += (found[columns].to_numpy() / found[["n"]].to_numpy()).astype(np.float32)
        model = Attention(matrix, vocabulary)
    return model


# --- scores -----------------------------------------------------------------


def _base(c: Column, total: int, distinct: int) -> Column:
    return F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))


def _frequent(counts: DataFrame, most: int = FREQUENT_WORDS) -> dict[bytes, int]:
    """Counts of the words from some count on, at most ``most``. The rest isn't lost: it is joined by shuffle."""
    grade = F.floor(8 * F.log2("c")).cast("int")  # a few hundred grades
    grades = sorted(((r["grade"], r["count"]) for r in counts.groupBy(grade.alias("grade")).count().collect()), reverse=True)
    least, held = None, 0
    for g, n in grades:
        if held + n > most:
            break
        least, held = g, held + n
    if least is None:
        return {}
    return {bytes(w): int(c) for w, c in counts.where(grade >= least).select("word", "c").toPandas().itertuples(index=False)}


_STATE: dict[str, Lexicon] = {}


def score(docs: DataFrame, in_training: Column, path: str, vocabulary: int, end_id: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole("text").alias("text"), in_training.alias("training"))
    training = rows.where("training")
    counts = materialize(word_counts(training), "words")
    ends = training.count()
    found = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (found["n"] or 0) + ends, found["v"] + (1 if ends else 0)

    frequent = _frequent(counts)
    logs_of, key = spark.sparkContext.broadcast(frequent), uuid.uuid4().hex  # of bounded size
    last = np.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))

    def lexicon_of() -> Lexicon:
        if key not in _STATE:
            _STATE.clear()
            frequent = logs_of.value
            logs = dict(zip(frequent, np.log10((np.array(list(frequent.values())) + 0.5) / (total + 0.5 * (distinct + 1))).tolist(), strict=True))
            _STATE[key] = Lexicon(_encoder(path), end_id, logs)
        return _STATE[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of()
        for b in batches:
            for part, texts in in_chunks(b, 1, _CHUNK_CHARS):
                ids, sizes, numbers, counts_ = lexicon.read(texts)
                logs, first = lexicon.log[numbers], counts_.cumsum() - counts_
                rare = np.isnan(logs)
                owner = np.repeat(np.arange(len(texts)), counts_)[rare]
                found, times = np.unique(owner << 40 | numbers[rare], return_counts=True)
                bounds = pa.array(np.searchsorted(found >> 40, np.arange(len(texts) + 1)).astype(np.int32))
                names = [lexicon.names[i] for i in (found & (1 << 40) - 1).tolist()]
                words = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times.astype(np.int32))], ["word", "tf"])
                known = np.add.reduceat((~rare).astype(np.int64), first) - (ends == 0)
                base = np.add.reduceat(np.where(rare, 0.0, logs), first) + last
                yield pa.record_batch(
                    [part.column(0), part.column(2), part.column(3), pa.array(counts_), pa.array(known), pa.array(base), _packed(ids, sizes, vocabulary), pa.ListArray.from_arrays(bounds, words)],
                    ["doc_id", "text_key", "training", "n_tokens", "n_known", "base_score", "ids", "rare"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), "training")
    same = f"doc_id {id_type}, text_key long"
    texts_read = materialize(keyed.mapInArrow(read, f"{same}, training boolean, n_tokens long, n_known long, base_score double, ids binary, rare array<struct<word: binary, tf: int>>"), "read")
    tokens = [_encoder(path).engine.decode_single_token_bytes(i) if i != end_id else b"" for i in range(vocabulary)]
    kinds = np.array([2 * (t[:1] == b" ") + any(c > 127 for c in t) for t in tokens])
    classes, within = classes_of(subword_counts(texts_read.where("training"), vocabulary), kinds)
    model = train(texts_read.where("training"), path, classes, vocabulary, end_id)

    shared = spark.sparkContext.broadcast((model, classes, within))  # all of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            for part, ids, sizes in _unpacked(b, b.num_columns - 1, vocabulary):
                yield pa.record_batch([*part.columns[:-1], pa.array(scorer.score(ids, sizes, end_id))], [*part.schema.names[:-1], "score"])

    unscored = texts_read.select("doc_id", "text_key", "n_tokens", "n_known", "base_score", "ids")
    scored = materialize(unscored.mapInArrow(run, f"{same}, n_tokens long, n_known long, base_score double, score double"), "scored")
    others = texts_read.select("doc_id", "text_key", F.inline("rare")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = others.groupBy("doc_id", "text_key").agg(F.sum(F.col("tf") * _base(c, total, distinct)).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"))
    times = scored.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    sums = sums.join(times, sums["doc_id"].eqNullSafe(times["doc_id"]) & (sums["text_key"] == times["text_key"]), "inner").select(sums["doc_id"].alias("_id"), sums["text_key"].alias("_key"), (F.col("more") / F.col("times")).alias("more"), (F.col("known") / F.col("times")).alias("known"))
    out = scored.join(sums, scored["doc_id"].eqNullSafe(sums["_id"]) & (scored["text_key"] == sums["_key"]), "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
