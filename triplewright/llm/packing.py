"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the packing instance is a histogram of at most ``capacity``
counts. Only that histogram reaches the driver:

1. reduction: sets of up to three pieces that dominate every other set holding their first piece are fixed,
   for all pieces of these lengths at once, until no set qualifies;
2. best-fit decreasing packs what remains;
3. the plan, a few intervals of ranks per length, places each piece by its rank among those of its length.

Ranks are dealt by (length, salt): each length is spread over ``SALTS`` salts, a very common one over one more for
each ``ROWS_A_SALT`` of its pieces, so no task ranks more rows than about that.

Defined results: a null text counts as empty and becomes one piece that holds the end id alone; a very long text
is encoded whole and gives as many pieces as it needs; pieces of one length are placed by salt, id, piece and ids;
repeated rows are packed each on its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.common import materialize
from triplewright.llm.token_ids import TextEncoder

CAPACITY = 1024
END_ID = 2
SALTS = 64
ROWS_A_SALT = 1_000_000
_CHUNK_CHARS = 4_000_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), in the order of their offsets


def reduce_instance(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take their pieces off ``counts`` (index: length). Returns the fixed patterns.

    For a piece of length w and the room r = capacity - w, a set {w, ...} dominates all others that hold w if
    each of those can be exchanged for it without using more sequences:

    * nothing else fits: {w};
    * a piece of exactly r exists: {w, r};
    * no two more fit, or no three more do and the best two are no longer than the best one, j: {w, j};
    * no three more fit, and the longest that fits goes with the longest up to r / 2: {w, j, k}.
    """
    capacity = len(counts) - 1
    fixed: list[tuple[Pattern, int]] = []

    def fix(*sizes: int) -> None:
        need = {s: sizes.count(s) for s in sizes}
        n = min(int(counts[s]) // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= n * k
        fixed.append((tuple((s, need[s]) for s in dict.fromkeys(sizes)), n))

    def smallest(n: int) -> int:
        """Sum of the n smallest pieces that remain, or more than the capacity if there are fewer."""
        total = 0
        for s in np.flatnonzero(counts)[: n + 1]:
            take = min(n, int(counts[s]))
            total, n = total + take * int(s), n - take
            if not n:
                return total
        return capacity + 1

    def longest(up_to: int) -> int:
        found = np.flatnonzero(counts[: up_to + 1]) if up_to > 0 else []
        return int(found[-1]) if len(found) else 0

    def best_two(room: int) -> int:
        top, sizes = 0, np.flatnonzero(counts[: room + 1])
        for a in sizes:
            counts[a] -= 1
            b = longest(min(int(a), room - int(a)))
            counts[a] += 1
            top = max(top, int(a) + b if b else 0)
        return top

    def dominating(w: int) -> tuple[int, ...]:
        """What joins w in a dominating set; raises LookupError if there is none."""
        counts[w] -= 1
        try:
            room = capacity - w
            j = longest(room)
            if j in (0, room) or smallest(2) > room:
                return (j,) if j else ()
            if smallest(3) > room:
                if best_two(room) <= j:
                    return (j,)
                counts[j] -= 1
                k = longest(room - j)
                counts[j] += 1
                if k and k >= longest(room // 2):
                    return j, k
            raise LookupError
        finally:
            counts[w] += 1

    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while counts[w]:
                try:
                    fix(w, *dominating(w))
                except LookupError:
                    break
                changed = True
    return fixed


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; sequences with the same contents are handled together."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if n:
            (open_.setdefault(room, []) if room else done).append((pattern, n))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            rooms = [r for r in open_ if r >= size and open_[r]]
            room = min(rooms) if rooms else capacity
            each = room // size  # the sequence that just got a piece has the least room, so it is filled first
            pattern, n = open_[room].pop() if rooms else ((), -(-left // each))
            full = min(n, left // each)
            put((*pattern, (size, each)), full, room - each * size)
            left -= full * each
            n -= full
            if n and 0 < left < each:
                put((*pattern, (size, left)), 1, room - left * size)
                n, left = n - 1, 0
            if pattern:
                put(pattern, n, room)
    return done + [x for group in open_.values() for x in group]


@dataclass
class Plan:
    """Intervals of ranks per length: pieces lo <= rank < hi of a length go, ``many`` to a sequence, at ``offset``."""

    key: np.ndarray  # length << 44 | lo
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    fixed: int

    @classmethod
    def make(cls, histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
        counts = np.zeros(capacity + 1, np.int64)
        for size, n in histogram.items():
            counts[size] = n
        used, rows, at = np.zeros(capacity + 1, np.int64), [], 0
        reduced = reduce_instance(counts)
        for pattern, n in reduced + best_fit(counts):
            offset = 0
            for size, many in pattern:
                rows.append((size << 44 | int(used[size]), many, at, offset))
                used[size] += many * n
                offset += many * size
            at += n
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 4).T
        return cls(cols[0], cols[1], cols[2], cols[3], at, sum(n for _, n in reduced))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 44 | rank
        i = np.searchsorted(self.key, key, "right") - 1
        k = key - self.key[i]
        return self.sequence[i] + k // self.many[i], self.offset[i] + k % self.many[i] * length


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def in_chunks(batch: pa.RecordBatch, column: int, chars: int = _CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), each of about ``chars`` characters."""
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        texts = [t or "" for t in part.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                yield part.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Texts above the capacity are cut from their end.

    ``special_as_text``: see :class:`TextEncoder`.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((tokenizer_path, special_as_text)) or TextEncoder(tokenizer_path, special_as_text)
        _ENCODERS[tokenizer_path, special_as_text] = encoder
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for part, texts in in_chunks(b, 1):
                rows = []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(i, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
                cols = np.array(rows, np.int64).T
                yield pa.record_batch([part.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``found`` of :func:`pieces` with sequence_id and offset (gapless from 0 in each sequence)."""
    spark, found = found.sparkSession, materialize(found, "pieces")
    sizes = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan.make(sizes, capacity))
    dealt = F.broadcast(spark.createDataFrame([(k, max(salts, -(-n // ROWS_A_SALT))) for k, n in sizes.items()], "length long, salts long"))
    salted = found.join(dealt, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    cells = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    firsts = F.broadcast(cells.select("length", "salt", before.alias("first")))  # at most capacity x salts rows, and one per ROWS_A_SALT pieces
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
