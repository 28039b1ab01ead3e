"""N-gram Jaccard join as a metric-space join, exact, with results by connected component.

The Jaccard distance of shingle sets is a metric, but most texts are at distance 1 from nearly all others, so
pivots taken from the whole table would tell nothing apart. Regions are therefore seeded first, without
losing a pair. Two sets within the threshold differ in at most d elements, so of d + 1 parts of the hash space
at least one holds the same elements of both. Each set is keyed by the contents of its parts (``Parts`` has the
details: size classes, empty parts), and sets that share a key, directly or through others, form a seed
region. Before regions are formed, sets that share a key are compared by their parity sketches: two sets differ in
at least as many elements as their sketches differ in bits, so pairs that differ in too many bits are no
links, and passages that many texts share don't join regions. Differing bits are a metric, too, so here the
distances to a few pivots rule pairs out by the triangle inequality before sketches are compared. Links never cross seed regions. Within a region:

* pivots partition it into Voronoi regions: each set goes to its nearest pivot;
* a set is replicated into the region of pivot p if its distance to p is at most that to its own pivot plus
  twice the threshold distance: by the triangle inequality no link is missed then;
* regions join recursively; small ones compare all pairs whose distances to the pivots differ by no more
  than the threshold distance. Sets that already are in one component aren't compared again.

Regions of up to ``LEAF_SETS`` sets and ``LEAF_SHINGLES`` shingles do this in one task. Larger ones are
split by the same rule over the cluster first: dealt by salt and streamed past their pivots. A region whose
windows leave it nearly as many pairs as before is joined block against block, so memory stays bounded there too.

Equal sets are one node throughout. Shingles are 64-bit hashes of their words.

Defined results: a null text counts as empty; a text without words has no shingle and is linked with
nothing, not even other such texts; rows that repeat an id and a text get equal rows; rows without an id link
others like any row, and the component takes its id from the rest; a very long text is read whole, piece by piece; extra columns are
ignored by ``near_groups`` and kept by ``drop_near_copies``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from triplewright.llm.common import materialize
from triplewright.llm.components import components

HOT_SAMPLE = 100  # one text in so many tells which keys are hot
HOT_SEEN = 20  # times that a hot key occurs among these
HOT_KEYS = 100_000
HOT_SALTS = 64
SKETCH_BITS = 1024
_SKETCHED_AT_ONCE = 1 << 23  # bits
HUB_BLOCK = 8192  # sets of one hub compared in a task
HUB_BYTES = 1 << 25
HUB_PIVOTS = 4
FEW = 24  # sets that are compared one by one
LEAF_SETS = 4096
LEAF_SHINGLES = 4_000_000  # 32 MB
SMALL = 24
PIVOTS = 16
SHRINKS = 0.8  # windows are followed if they leave less than this share of a region's pairs
MEASURED_AT_ONCE = 256
LARGE_SHARE = 1000
_PIECE = 1 << 20
_BREAK = re.compile(rb"[\x09-\x0d\x20]")
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * _PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_BASE, inverse)]
    return _POWERS


def _pieces(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    """Lower-cased bytes of about ``_PIECE``, each text ended by a line feed, with the owner and end of each part.

    A long text goes over several pieces, cut at white space.
    """
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        data = text.encode().lower() + b"\n"
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > _PIECE:
                m = _BREAK.search(data, at + _PIECE)
                end = m.end() if m else end
            held.append(data[at:end])
            size += end - at
            owners += [i, size]
            at = end
            if size >= _PIECE:
                yield b"".join(held), owners
                held, owners, size = [], [], 0
    if held:
        yield b"".join(held), owners


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has.

    A word is a polynomial over its bytes: the difference of two prefix sums, moved to the origin by a power
    of the inverse base, so all words of a piece are hashed at once.
    """
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for data, owners in _pieces(texts):
        flat = np.frombuffer(data, np.uint8)
        power, inverse = _powers(len(flat) + 1)
        space = _SPACE[flat]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # the last byte is white space
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], dtype=np.uint64)])
        h = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _M[0]
        h ^= h >> np.uint64(32)
        h *= _M[1]
        h ^= h >> np.uint64(29)
        hashes.append(h)
        np.add.at(counts, owners[::2], np.diff(np.searchsorted(start, [0, *owners[1::2]])))
    return np.concatenate(hashes), counts


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * _M[0]
        out ^= out >> np.uint64(31)
    out *= _M[1]
    out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; a text without words (or null) has none.
    """
    h, counts = word_hashes([t or "" for t in texts])
    grams = _combined(h, width) if len(h) >= width else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            found = np.sort(grams[at : at + n - width + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        else:
            out.append(_combined(h[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def linked(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """The exact test: 100 * intersection >= percent * union."""
    return 100 * inter >= percent * (size_a + size_b - inter)


class Sets:
    """Shingle sets of one region, end to end, with exact distances from one set to all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], self.sizes.cumsum()[:-1]]).astype(np.int64)
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.often = np.bincount(self.flat, minlength=len(values))

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def shared(self, i: int, among: np.ndarray | None = None) -> np.ndarray:
        """Intersection sizes of set i with all sets, or with those of ``among``."""
        self.mark[self.of(i)] = True
        if among is None:
            out = np.add.reduceat(self.mark[self.flat], self.starts, dtype=np.int64)
        else:
            out = np.array([np.count_nonzero(self.mark[self.of(j)]) for j in among], np.int64)
        self.mark[self.of(i)] = False
        return out

    def central(self, among: np.ndarray) -> int:
        """The member whose shingles the region shares most."""
        mean = np.add.reduceat(self.often[self.flat], self.starts) / self.sizes
        return int(among[mean[among].argmax()])


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self, among: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(x)) for x in among])


def join_region(sets: list[np.ndarray], percent: int, grp: list[bytes] | None = None) -> np.ndarray:
    """Component (least member) of each set of a region, by recursive Voronoi joins. Sets of one ``grp`` are in one
    component from the start."""
    s, u, eps = Sets(sets), _Union(len(sets)), (100 - percent) / 100 + 1e-9
    first: dict[bytes, int] = {}
    for i, g in enumerate(grp or ()):
        u.join(first.setdefault(g, i), i)

    def compare(members: np.ndarray, table: np.ndarray | None) -> None:
        """All pairs of different components whose distances to the pivots allow a link."""
        for k, x in enumerate(members[:-1]):
            rest = members[k + 1 :]
            keep = u.roots(rest) != u.find(int(x))
            keep &= (100 * s.sizes[rest] >= percent * s.sizes[x]) & (100 * s.sizes[x] >= percent * s.sizes[rest])
            if table is not None:
                keep &= np.abs(table[k + 1 :] - table[k]).max(1) <= eps
            rest = rest[keep]
            if len(rest):
                for y in rest[linked(s.shared(int(x), rest), s.sizes[x], s.sizes[rest], percent)]:
                    u.join(int(x), int(y))

    def divide(members: np.ndarray, before: int) -> None:
        if len(np.unique(u.roots(members))) < 2:
            return
        if len(members) <= SMALL:
            return compare(members, None)
        pivots = [s.central(members)]
        nearest, columns = None, []
        for _ in range(min(PIVOTS, len(members) // 8)):
            p = pivots[-1]
            inter = s.shared(p)[members]
            d = 1 - inter / (s.sizes[members] + s.sizes[p] - inter)
            columns.append(d)
            for x in members[linked(inter, s.sizes[members], s.sizes[p], percent)]:
                u.join(p, int(x))
            nearest = d if nearest is None else np.minimum(nearest, d)
            pivots.append(int(members[nearest.argmax()]))  # the next pivot is the set farthest from those so far
        table = np.stack(columns, 1)
        regions = [members[table[:, i] <= nearest + 2 * eps] for i in range(table.shape[1])]
        if max(map(len, regions)) > 0.8 * len(members) or before > 12:
            return compare(members, table)
        for region in regions:
            divide(region, before + 1)

    divide(np.arange(len(sets)), 0)
    return u.roots(np.arange(len(sets)))


def _empty_parts(elements: int, parts: int) -> float:
    """How many parts hardly any set of so many elements leaves empty: 3.5 deviations above the mean."""
    one, two = np.exp(elements * np.log1p(-1 / parts)), np.exp(elements * np.log1p(-2 / parts))
    mean = parts * one
    return mean + 3.5 * np.sqrt(max(0.0, mean + parts * (parts - 1) * two - mean**2))


class Parts:
    """Keys of shingle sets such that sets within the threshold share one.

    Sizes fall into classes [lo, hi). A pair is found in the class of its smaller set: a set is keyed in its own
    class, and in the class below if a set there may be within the threshold. In a class, sets within the
    threshold differ in at most d elements, d from its largest sizes. Sets are cut into m = d + 1 + e parts by
    hash range, so at least e + 1 parts agree. A set with at most e empty parts then shares a part that isn't
    empty with each partner; e is chosen so that hardly any set has more, and one that does is keyed by its
    empty parts as well, where it meets all others of that kind. Sets too small for a partner have no keys.
    """

    def __init__(self, percent: int, growth: float = 1.5, largest: int = 1 << 31):
        self.percent = percent
        self.least = -(-percent // (100 - percent))  # with fewer elements, only equal sets are within the threshold
        lo, bounds, m, e = self.least, [], [], []
        while lo <= largest:
            hi = int(lo * growth) + 1
            small, big = hi - 1, (hi - 1) * 100 // percent
            d = (100 - percent) * (small + big) // (100 + percent)
            parts = d + 2
            while parts - d - 1 < _empty_parts(lo, parts):
                parts += 1 + parts // 200
            bounds.append(lo)
            m.append(parts)
            e.append(parts - d - 1)
            lo = hi
        self.lo, self.m, self.e = np.array(bounds), np.array(m), np.array(e)

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the index of the set each belongs to."""
        sizes = np.array([len(x) for x in sets], np.int64)
        own = np.searchsorted(self.lo, sizes, "right") - 1
        below = own - 1
        reach = -(-self.percent * sizes // 100)  # the least size of a partner
        also = np.flatnonzero((below >= 0) & (self.lo[np.maximum(own, 0)] - 1 >= reach))
        mine = np.flatnonzero(own >= 0)
        which, cls = np.concatenate([mine, also]), np.concatenate([own[mine], below[also]])
        if not len(which):
            return np.zeros(0, np.uint64), which
        n = sizes[which]
        flat = np.concatenate([sets[i] for i in which])
        m = self.m[cls]
        part = ((flat >> np.uint64(32)) * np.repeat(m, n).astype(np.uint64)) >> np.uint64(32)  # rises with the hash
        owner = np.repeat(np.arange(len(which)), n)
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
        sums = np.add.reduceat(_mixed(flat), first)
        at, row = part[first], owner[first]
        keys = _mixed(sums ^ _mixed(at + (cls[row].astype(np.uint64) << np.uint64(40))))
        empty = m - np.bincount(row, minlength=len(which))
        more_keys, more_rows = [keys], [row]
        for i in np.flatnonzero(empty > self.e[cls]):
            missing = np.setdiff1d(np.arange(m[i], dtype=np.uint64), at[row == i])
            more_keys.append(_mixed(_mixed(missing + (np.uint64(cls[i]) << np.uint64(40))) + np.uint64(1)))
            more_rows.append(np.full(len(missing), i))
        return np.concatenate(more_keys), which[np.concatenate(more_rows)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parity sketches: bit i of 2**k is the parity of the elements whose hash ends in i. There are at least as many
    bits as elements, and ``SKETCH_BITS``, so sets of any size that differ much have sketches that do."""
    sizes = np.array([len(x) for x in sets], np.int64)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    out = [b""] * len(sets)
    for n in np.unique(bits).tolist():
        same, each = np.flatnonzero(bits == n), max(1, _SKETCHED_AT_ONCE // n)
        for at in range(0, len(same), each):
            part = same[at : at + each]
            ends = (np.concatenate([sets[i] for i in part]) & np.uint64(n - 1)).astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(part)), sizes[part]) * n + ends, minlength=len(part) * n) & 1
            for i, x in zip(part.tolist(), np.packbits(odd.astype(np.uint8)).reshape(len(part), -1), strict=True):
                out[i] = x.tobytes()
    return out


def folded(drawn: np.ndarray, words: int) -> np.ndarray:
    """Sketches (sets, words of 64 bits) as sketches of fewer words: a shorter one is the parity of a longer one's parts."""
    return np.bitwise_xor.reduce(drawn.reshape(len(drawn), -1, words), axis=1)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = shingle_sets(part.column(1).to_pylist(), width)
                drawn = sketches(found)
                yield pa.record_batch([part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(list(map(digest, found)), pa.binary()), pa.array(drawn, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, node binary, sketch binary")


def _with_node(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with the digest of each row's set as _tw_node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = shingle_sets(part.column(part.schema.get_field_index("text")).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(digest, found)), pa.binary())], [*part.schema.names, "_tw_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_tw_node", BinaryType())]))


def short(node: bytes) -> int:
    """The node's first 64 bits, which seed edges go by: two nodes with the same ones only share a seed region."""
    return int.from_bytes(node[:8], "big", signed=True)


def seed_keys(docs: DataFrame, width: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """key, salt, node (short): one row per key of each row's set; hot keys are dealt over ``HOT_SALTS`` salts."""
    shared = docs.sparkSession.sparkContext.broadcast(hot if hot is not None else np.zeros(0, np.uint64))  # at most HOT_KEYS longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hot = Parts(percent), shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = shingle_sets(b.column(0).slice(at, 500).to_pylist(), width)
                keys, rows = parts.keys(sets)
                nodes = np.array([short(digest(x)) for x in sets], np.int64)[rows]
                slot = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
                is_hot = hot[slot] == keys if len(hot) else np.zeros(len(keys), bool)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.where(is_hot, 1 + nodes % HOT_SALTS, 0).astype(np.int32)), pa.array(nodes)], ["key", "salt", "node"])

    return docs.select("text").mapInArrow(run, "key long, salt int, node long")


def hot_keys(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Keys that many rows share, from one text in ``HOT_SAMPLE``. They only decide what is salted, not what is found."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    often = seed_keys(some, width, percent).groupBy("key").count().where(F.col("count") >= HOT_SEEN)
    found = often.orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key").toPandas()["key"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def seed_edges(keys: DataFrame) -> DataFrame:
    """Edges from each node to the least one with the same key: per (key, salt), then over all salts of hot keys."""
    local = keys.withColumn("head", F.min("node").over(Window.partitionBy("key", "salt")))
    kept = local.where("node <> head or salt > 0").select(F.when(F.col("salt") > 0, F.col("key")).alias("hot"), "node", "head").distinct()
    kept = materialize(kept, "seed-edges")
    edges = kept.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    hot = kept.where("hot is not null").select("hot", "node", "head")
    tops = hot.groupBy("hot").agg(F.min("head").alias("top"))
    hot = hot.join(tops, "hot").where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"))
    return edges.unionByName(hot).distinct()


def _fold(sketch: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        sketch = sketch >> bits ^ sketch & ((1 << bits) - 1)
    return sketch


def _few(size: list[int], sketch: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that sizes and sketches allow, of a few sets in the order of their sizes."""
    drawn, bits = [int.from_bytes(x, "little") for x in sketch], [8 * len(x) for x in sketch]
    for x in range(len(size)):
        for y in range(x + 1, len(size)):
            if 100 * size[x] >= percent * size[y]:
                differ = (drawn[x] ^ _fold(drawn[y], bits[y], bits[x])).bit_count()
                if (100 + percent) * differ <= (100 - percent) * (size[x] + size[y]):
                    yield x, y


def pivot_distances(short: np.ndarray) -> np.ndarray:
    """(sets, pivots): bits in which sketches of one length differ from those of pivots, each the farthest from the ones before."""
    at, nearest, out = 0, None, []
    for _ in range(min(HUB_PIVOTS, len(short))):
        d = np.bitwise_count(short ^ short[at]).sum(1, dtype=np.int64)
        out.append(d)
        nearest = d if nearest is None else np.minimum(nearest, d)
        at = int(nearest.argmax())
    return np.stack(out, 1)


def _many(size: np.ndarray, sketch: list[bytes], percent: int, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """The same for many sets, without pairs of one ``group``, which grows as the pairs are taken.

    Differing bits are a metric, so sets whose distances to a pivot lie farther apart than the difference that
    their sizes allow are no pair, and their sketches aren't compared.
    """
    words = np.array([len(x) // 8 for x in sketch])  # rises with the size
    drawn = {n: np.frombuffer(b"".join([x for x in sketch if len(x) == 8 * n]), np.uint64).reshape(-1, n) for n in np.unique(words).tolist()}
    first = {n: int(np.searchsorted(words, n)) for n in drawn}
    reach = np.searchsorted(size, 100 * size // percent, "right").tolist()  # up to the largest that a set may be linked to
    far_from = pivot_distances(np.concatenate([folded(drawn[n], SKETCH_BITS // 64) for n in drawn]))
    for short, own in drawn.items():
        at = first[short]
        for long, theirs in drawn.items():
            far = first[long]
            if long < short or reach[at + len(own) - 1] <= far:
                continue
            theirs = folded(theirs, short)
            for x in range(at, at + len(own)):
                rest = np.arange(max(x + 1, far), min(reach[x], far + len(theirs)))
                rest = rest[group[rest] != group[x]]
                allowed = (100 - percent) * (size[rest] + size[x]) // (100 + percent)
                near = (np.abs(far_from[rest] - far_from[x]) <= allowed[:, None]).all(1)
                rest, allowed = rest[near], allowed[near]
                if len(rest):
                    differ = np.bitwise_count(theirs[rest - far] ^ own[x - at]).sum(1, dtype=np.int64)
                    for y in rest[differ <= allowed].tolist():
                        yield x, y


def _compatible(percent: int):  # noqa: ANN202
    """Spanning edges of the pairs of a hub's sets that sizes and sketches allow to be within the threshold: sketches
    differ in at most as many bits as the sets in elements, and that is at most a certain share of both sizes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(table["n_shingles"].to_pylist(), table["node"].to_pylist(), table["sketch"].to_pylist(), strict=True)))
        size, node, sketch = map(list, zip(*rows, strict=True))
        group, edges = np.arange(len(rows)), []
        for x, y in _few(size, sketch, percent) if len(rows) <= FEW else _many(np.array(size), sketch, percent, group):
            if group[y] != group[x]:
                edges.append((node[x], node[y]))
                group[group == group[y]] = group[x]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def refined(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Seed edges without pairs that sketches exclude.

    All sets that share a key have an edge to the same head, so the sets around a head hold every link that the
    key stands for. A head with more than ``HUB_BLOCK`` sets, or ``HUB_BYTES`` of sketches, is compared block against
    block.
    """
    members = edges.select(F.col("b").alias("hub"), F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("hub"), F.col("b").alias("node"))).distinct()
    known = sets.select(_brief().alias("node"), "n_shingles", "sketch").distinct()
    members = members.join(known, "node")
    load = F.greatest(F.count(F.lit(1)) / HUB_BLOCK, F.sum(F.octet_length("sketch")) / HUB_BYTES)
    blocks = members.groupBy("hub").agg(F.ceil(load).cast("int").alias("blocks"))
    dealt = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = pair.select("hub", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "n_shingles", "sketch")
    return pair.groupBy("hub", "i", "j").applyInArrow(_compatible(percent), "a long, b long").distinct()


def _brief() -> Column:
    """:func:`short` as a column."""
    return F.conv(F.substring(F.hex("node"), 1, 16), 16, -10).cast("long")


_MEMBER = "region string, node binary, shingles binary"


def _members(docs: DataFrame, sets: DataFrame, seeds: DataFrame, width: int) -> DataFrame:
    """region, node, shingles: one row per distinct set of a seed region, its shingles taken from one text again."""
    chosen = sets.withColumn("brief", _brief()).join(seeds.withColumnRenamed("node", "brief"), "brief").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("root").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingle_sets(b.column(2).to_pylist(), width)
            keep = [i for i, (f, node) in enumerate(zip(found, b.column(1).to_pylist(), strict=True)) if digest(f) == node]  # an id may have several texts
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["region", "node", "shingles"])

    texts = chosen.select("doc_id", "node", "root").join(docs.select("doc_id", "text"), "doc_id").select("root", "node", "text")
    without = _with_node(docs.select("doc_id", "text").where("doc_id is null"), width).select(F.col("_tw_node").alias("node"), "text")  # only their sets tell these rows apart
    texts = texts.unionByName(chosen.where("doc_id is null").select("node", "root").join(without.dropDuplicates(["node"]), "node").select("root", "node", "text"))
    return texts.select(F.col("root").cast("string").alias("region"), "node", "text").mapInArrow(run, _MEMBER).dropDuplicates(["region", "node"])


def _as_sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in pdf.shingles]


def _leaf(percent: int):  # noqa: ANN202
    """Links of a region, or of two of its blocks, that one task compares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        root = join_region(_as_sets(pdf), percent, pdf.grp.tolist())
        far = np.flatnonzero(root != np.arange(len(pdf)))
        return pd.DataFrame({"a": pdf.node[far].tolist(), "b": pdf.node[root[far]].tolist()})

    return run


class Pivots:
    """The pivots of a region, their elements side by side, so that many sets are measured at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.values = np.unique(np.concatenate(sets))
        self.held = np.zeros(len(self.values), np.int64)
        for k, x in enumerate(sets):
            self.held[np.searchsorted(self.values, x)] |= 1 << k

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """Intersection sizes, (sets, pivots)."""
        sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
        held = np.where(self.values[at] == flat, self.held[at], 0)
        starts = np.concatenate([[0], sizes.cumsum()[:-1]])
        return np.stack([np.add.reduceat(held >> k & 1, starts) for k in range(len(self.sizes))], 1)


_MEASURED = "region string, node binary, hits long, links array<int>, inside array<int>"


def _measure(percent: int):  # noqa: ANN202
    """Streams rows (region, salt, turn, node, shingles), each group's pivots (turn 0) first, and measures the members
    (turn 1): the pivots each is linked to, as bits and as a list, and the Voronoi regions that its window reaches."""
    eps = (100 - percent) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres, pivots = None, [], None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end < at + MEASURED_AT_ONCE and keys[end] == keys[at]:
                    end += 1
                part = b.slice(at, end - at)
                sets = [np.frombuffer(x, np.uint64) for x in part.column(4).to_pylist()]
                if keys[at][2] == 0:
                    if keys[at][:2] != now:
                        now, centres = keys[at][:2], []
                    centres, pivots = centres + sets, None
                else:
                    pivots = pivots or Pivots(centres)
                    inter, size = pivots.shared(sets), np.array([len(x) for x in sets], np.int64)[:, None]
                    hit, d = linked(inter, size, pivots.sizes, percent), 1 - inter / (size + pivots.sizes - inter)
                    near = d <= d.min(1, keepdims=True) + 2 * eps
                    lists = [pa.array([np.flatnonzero(x).tolist() for x in y], pa.list_(pa.int32())) for y in (hit, near)]
                    bits = pa.array((hit.astype(np.int64) << np.arange(hit.shape[1])).sum(1), pa.int64())
                    yield pa.record_batch([part.column(0), part.column(3), bits, *lists], ["region", "node", "hits", "links", "inside"])
                at = end

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each region and bit set of linked pivots: the least pivot of the class that these pivots are in."""
    for b in batches:
        for region, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u = _Union(PIVOTS)
            bits = [[k for k in range(PIVOTS) if m >> k & 1] for m in masks]
            for x in bits:
                for k in x:
                    u.join(x[0], k)
            yield pa.record_batch([pa.array([region] * len(masks)), pa.array(masks, pa.int64()), pa.array([u.find(x[0]) for x in bits], pa.int32())], ["region", "hits", "head"])


def _weigh(members: DataFrame) -> DataFrame:
    """region, n, parts (the tasks a region needs) of the regions whose sets aren't all known to be in one component."""
    load = F.greatest(F.count(F.lit(1)) / LEAF_SETS, F.sum(F.octet_length("shingles")) / (8 * LEAF_SHINGLES))
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.ceil(load).cast("int").alias("parts"), (F.min("grp") != F.max("grp")).alias("mixed")).where("mixed").drop("mixed")


def region_links(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes that give the components of the exact link graph.

    ``grp`` names sets that links found so far put into one component: pairs within one aren't compared, and
    regions of a single one are done. A region too large for a task is measured against its pivots, in a stream
    that holds the pivots and a few rows. If the windows then leave clearly fewer pairs to compare than the region
    has, its Voronoi regions go on (at most four copies of a set), else its blocks are compared in pairs.
    """
    links: list[DataFrame] = []
    todo = materialize(members.withColumn("grp", F.col("node")), "regions")
    while True:
        sized = materialize(_weigh(todo), "region-sizes")
        joined = todo.join(sized, "region")
        links.append(joined.where("parts <= 1").select("region", "node", "grp", "shingles").groupBy("region").applyInPandas(_leaf(percent), "a binary, b binary"))
        if sized.where("parts > 1").isEmpty():
            break
        large = joined.where("parts > 1")
        order = Window.partitionBy("region").orderBy(F.xxhash64("region", "node"), "node")
        pivots = large.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < PIVOTS)
        pivots = materialize(pivots.select("region", "nth", "node", "shingles", "parts"), "pivots")  # PIVOTS rows a region
        dealt = large.select("region", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("salt"), F.lit(1).alias("turn"), "node", "shingles", F.lit(0).alias("nth"))
        every = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("turn"), "node", "shingles", "nth")
        rows = dealt.unionByName(every).repartition("region", "salt").sortWithinPartitions("region", "salt", "turn", "nth").drop("nth")
        found = materialize(rows.mapInArrow(_measure(percent), _MEASURED), "measured")
        hit = found.select("region", F.col("node").alias("a"), F.explode("links").alias("nth"))
        links.append(hit.join(pivots.select("region", "nth", F.col("node").alias("b")), ["region", "nth"]).where("a <> b").select("a", "b"))

        masks = found.where("hits > 0").groupBy("region").agg(F.collect_set("hits").alias("masks"))
        heads = masks.mapInArrow(_heads, "region string, hits long, head int")
        grp = F.when(F.col("head").isNotNull(), F.concat(F.lit("linked to a pivot of region "), "region", F.lit(" "), "head").cast("binary")).otherwise(F.col("grp"))
        found = found.join(heads, ["region", "hits"], "left").select("region", "node", "head", "inside")
        work = found.select("region", F.explode("inside").alias("k")).groupBy("region", "k").count().groupBy("region").agg(F.sum(F.pow("count", F.lit(2))).alias("pairs"))
        plan = materialize(sized.join(work, "region").select("region", "parts", (F.col("pairs") < SHRINKS * F.pow("n", F.lit(2))).alias("shrinks")), "plan")
        after = large.drop("n", "parts").join(found, ["region", "node"]).withColumn("grp", grp).join(plan, "region")
        mixed = after.groupBy("region").agg((F.min("grp") != F.max("grp")).alias("mixed")).where("mixed").select("region")
        after = materialize(after.join(mixed, "region", "left_semi"), "grouped")

        fixed = after.where("not shrinks").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), 2 * F.col("parts")).cast("int"))
        pair = fixed.withColumn("with", F.explode(F.sequence(F.lit(0), 2 * F.col("parts") - 1)))
        pair = pair.select("region", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "grp", "shingles")
        links.append(pair.groupBy("region", "i", "j").applyInPandas(_leaf(percent), "a binary, b binary"))
        inner = after.where("shrinks").withColumn("k", F.explode("inside"))
        todo = materialize(inner.select(F.concat_ws(".", "region", "k").alias("region"), "node", "grp", "shingles"), "regions")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_groups`` with each row's node and keep_node: of the rows of the component's least id, the least node."""
    docs = docs.select("doc_id", "text")
    sets = materialize(sets_of(docs, width), "sets")
    seeds = seed_edges(seed_keys(docs, width, percent, hot_keys(docs, width, percent)))
    seeds = components(refined(seeds, sets, percent), "seeds")
    links = region_links(_members(docs, sets, seeds, width), percent)
    roots = components(links, "links")
    own = F.when(F.col("n_shingles") > 0, F.col("node"))
    rows = materialize(sets.join(roots, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", own).alias("root")), "rooted")
    least = rows.where("root is not null").groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))).alias("kept"), F.count(F.lit(1)).alias("members"))
    least = least.select("root", F.col("kept.doc_id").alias("component_id"), F.col("kept.node").alias("keep_node"), "members")
    least = materialize(least, "classes")
    total = least.agg(F.sum("members").alias("n")).first()["n"] or 0
    large = F.broadcast(least.where(F.col("members") > total // LARGE_SHARE))  # fewer than LARGE_SHARE rows
    small = least.where(F.col("members") <= total // LARGE_SHARE)
    parts = [rows.join(large, "root"), rows.join(large, "root", "left_anti").join(small, "root")]
    out = parts[0].unionByName(parts[1]).select("doc_id", "n_shingles", "component_id", "node", "keep_node")
    return out.unionByName(rows.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", F.col("node").alias("keep_node")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each group of near copies: that of the least id, and of its least set where the id
    has several in the group. Rows of null id stay; rows that repeat the kept row's id and set stay with it."""
    groups = _grouped(docs, width, percent).where("doc_id is not null")
    gone = (F.col("doc_id") != F.col("component_id")) | (F.col("node") != F.col("keep_node"))
    groups = groups.select(F.col("doc_id").alias("_tw_id"), F.col("node").alias("_tw_node"), gone.alias("gone"))
    ids = groups.groupBy("_tw_id").agg(F.max("gone").alias("some"), F.min("gone").alias("every")).where("some")
    ids = materialize(ids, "gone")
    mixed = ids.where("not every").select("_tw_id")
    out = docs.join(ids.select("_tw_id"), docs["doc_id"] == F.col("_tw_id"), "left_anti")
    if mixed.isEmpty():
        return out
    part = _with_node(docs.join(mixed, docs["doc_id"] == F.col("_tw_id"), "left_semi"), width)  # ids of which some sets stay
    copies = groups.where("gone").select("_tw_id", F.col("_tw_node").alias("_tw_gone"))
    part = part.join(copies, (part["doc_id"] == F.col("_tw_id")) & (part["_tw_node"] == F.col("_tw_gone")), "left_anti")
    return out.unionByName(part.drop("_tw_node"))
