"""Byte-level BPE encoding and decoding by DuckDB queries, run inside each partition.

Encoding: each match of the pre-token pattern is a word. The distinct words that a chunk of texts brings
become token-position rows; a recursive query joins neighbouring tokens with the merge table and contracts,
in each word, the leftmost pair of the least rank, until no word has a pair left.

Words of more than ``LONG_WORD`` bytes would take as many steps as they have merges, so they go through a loop of
queries that keeps only the newest rows. A step contracts every pair that has the least rank within ``reach`` bytes
on both sides, the leftmost first. That changes no result: a merge elsewhere could only get there as part of a
token longer than any that occurs in the word, and ``reach`` is twice the longest of these. Pairs of equal rank that
overlap (a run of one token) are taken as a whole, every second one, and only if all of them have the least rank.

Decoding: rows of (word, position, id) are joined with the vocabulary and their bytes concatenated by an
ordered aggregation, once per distinct word; a text is its words' bytes in order. :meth:`SqlBpe.decode` does the
same for any ids.

Defined results: a null text counts as empty and has no ids; strings of special tokens are ordinary text;
of equal ranks in a word the leftmost goes first; a very long text is encoded whole, and a very long word takes
memory in proportion to its length; repeated rows give repeated results; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.packing import in_chunks

_CHUNK_CHARS = 3_000_000
_MAX_WORDS = 300_000
LONG_WORD = 64
_ROWS_A_CALL = 6_000_000  # of a recursive query, at most: a word of n bytes gives less than n * n / 2
_MEMORY_MB = 400
_BYTES_A_ROW = 512  # of a long word
_SHIFT = 1 << 21  # above any id
_NONE = -1

#: A token covers the bytes pos <= i < fin of all words put end to end; nxt is its right neighbour in the word, or -1.
_ENCODE = f"""
WITH RECURSIVE steps(step, word, pos, fin, tok, nxt) AS (
  SELECT 0, word, pos, pos + 1, tok, nxt FROM start_rows
  UNION ALL (
  WITH best AS MATERIALIZED (
    SELECT a.word, min(m.merged * 4294967296 + a.pos) AS best
    FROM steps a JOIN merges m ON m.pair = a.tok::BIGINT * {_SHIFT} + a.nxt GROUP BY a.word
  ), chosen AS MATERIALIZED (
    SELECT b.word, a.pos, a.fin AS mid, (best >> 32)::INTEGER AS merged FROM best b JOIN steps a ON a.pos = best & 4294967295
  ), hit AS MATERIALIZED (
    SELECT c.word, c.pos, c.mid, c.merged, e.fin, e.nxt FROM chosen c JOIN steps e ON e.pos = c.mid
  )
  SELECT a.step + 1, a.word, a.pos, CASE WHEN a.pos = h.pos THEN h.fin ELSE a.fin END, CASE WHEN a.pos = h.pos THEN merged ELSE a.tok END,
         CASE WHEN a.pos = h.pos THEN h.nxt WHEN a.fin = h.pos THEN merged ELSE a.nxt END
  FROM steps a JOIN hit h ON a.word = h.word WHERE a.pos <> h.mid
  )
)
SELECT word, tok FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step) ORDER BY pos
"""

#: One step over the rows of long words (table ``tokens``); reach is a column of each word.
_PAIRS = f"""
CREATE OR REPLACE TEMP TABLE pairs AS
SELECT a.word, a.pos, a.fin, m.merged, m.alone, min(m.merged) OVER near AS least,
       coalesce(lag(a.fin) OVER same = a.pos, false) AS laps, coalesce(lag(a.pos) OVER same >= a.pos - reach, false) AS follows
FROM tokens a JOIN reaches USING (word) JOIN merges m ON m.pair = a.tok::BIGINT * {_SHIFT} + a.nxt
WINDOW near AS (PARTITION BY a.word ORDER BY a.pos RANGE BETWEEN reach PRECEDING AND reach FOLLOWING), same AS (PARTITION BY a.word, m.merged ORDER BY a.pos)
"""
_CONTRACT = """
CREATE OR REPLACE TEMP TABLE tokens AS
WITH runs AS (
  SELECT *, sum(CASE WHEN laps THEN 0 ELSE 1 END) OVER (PARTITION BY word, merged ORDER BY pos) AS run FROM pairs
), chosen AS MATERIALIZED (
  SELECT pos, fin AS mid, merged FROM runs
  QUALIFY bool_and(merged = least) OVER (PARTITION BY word, merged, run)
    AND CASE WHEN alone THEN NOT follows ELSE row_number() OVER (PARTITION BY word, merged, run ORDER BY pos) % 2 = 1 END
), kept AS (
  SELECT a.word, a.pos, coalesce(c.merged, a.tok) AS tok FROM tokens a LEFT JOIN chosen c ON c.pos = a.pos ANTI JOIN chosen eaten ON eaten.mid = a.pos
)
SELECT word, pos, lead(pos) OVER w AS fin, tok, coalesce(lead(tok) OVER w, -1) AS nxt FROM kept WINDOW w AS (PARTITION BY word ORDER BY pos)
"""

_DECODE = """
SELECT t.word, string_agg(v.chars, '' ORDER BY t.pos) AS chars
FROM token_rows t JOIN vocab v ON v.tok = t.tok GROUP BY t.word ORDER BY t.word
"""


class MergeTable:
    """Ranks of a ``.tiktoken`` file as a merge table.

    A pair may merge when its bytes joined are a token; the rank of the merge is that token's rank. A token is
    *alone* if it is part of some token of a lower rank: contracting it could then call for a merge that ranks
    before further contractions of the same pair, so in long words these go one at a time.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        parts = []
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                left, right = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if left is not None and right is not None:
                    parts.append((left, right, rank))
        l, r, merged = np.array(parts, np.int64).reshape(-1, 3).T
        alone = np.union1d(l[l > merged], r[r > merged])
        self.merges = pa.table({"pair": l * _SHIFT + r, "merged": merged.astype(np.int32), "alone": np.isin(merged, alone)})
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # a byte b as the character 256 + b, so that concatenated bytes are a valid string
        self.vocab = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "chars": ["".join(chr(256 + b) for b in k) for k in self.ranks]})


def _rows(words: list[bytes], byte_ids: np.ndarray) -> pa.Table:
    """One row per byte: word, pos, tok and the next byte's token."""
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    tok = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.full(len(tok), _NONE, np.int32)
    nxt[:-1] = np.where(owner[1:] == owner[:-1], tok[1:], _NONE)
    return pa.table({"word": owner, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok, "nxt": nxt})


def _cut(sizes: np.ndarray, least: int, most: int) -> list[int]:
    """Bounds of stretches whose sizes sum to about ``most``, at least ``least`` items each."""
    bounds, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > most and i - bounds[-1] >= least:
            bounds.append(i)
            held = 0
        held += n
    return [*bounds, len(sizes)]


class SqlBpe:
    """Encoder and decoder of one Python worker. Ids and bytes of distinct words stay, up to a bounded number of words."""

    def __init__(self, path: str, pattern: str, max_words: int = _MAX_WORDS, memory_mb: int = _MEMORY_MB):
        self.pattern, self.max_words, self.memory_mb = regex.compile(pattern), max_words, memory_mb
        self.table = MergeTable(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": ""})
        for name in ("merges", "vocab"):
            given = getattr(self.table, name)  # noqa: F841  (read by name below)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.tokens: ahocorasick.Automaton | None = None
        self.ids: dict[str, bytes] = {}
        self.bytes: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _longest(self, word: bytes) -> int:
        """Bytes of the longest token that occurs in the word."""
        if self.tokens is None:
            self.tokens = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for token in self.table.ranks:
                self.tokens.add_word(token.decode("latin-1"))
            self.tokens.make_automaton()
        return max((n for _, n in self.tokens.iter(word.decode("latin-1"))), default=1)

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words, step by step."""
        size = sum(map(len, words))
        self.db.execute(f"SET memory_limit = '{max(self.memory_mb, size * _BYTES_A_ROW >> 20)}MB'")
        start_rows = _rows(words, self.table.byte_ids)  # noqa: F841
        reach = pa.table({"word": np.arange(len(words), dtype=np.int32), "reach": np.array([2 * self._longest(w) for w in words], np.int32)})  # noqa: F841
        self.db.execute("CREATE OR REPLACE TEMP TABLE reaches AS SELECT * FROM reach")
        self.db.execute("CREATE OR REPLACE TEMP TABLE tokens AS SELECT word, pos, pos + 1 AS fin, tok, nxt FROM start_rows")
        while True:
            self.db.execute(_PAIRS)
            if not self.db.execute("SELECT count(*) FROM pairs").fetchone()[0]:
                break
            self.db.execute(_CONTRACT)
        found = self.db.execute("SELECT word, tok FROM tokens ORDER BY pos").fetchnumpy()
        self.db.execute("DROP TABLE tokens; DROP TABLE pairs; DROP TABLE reaches")
        self.db.execute(f"SET memory_limit = '{self.memory_mb}MB'")
        return _split(found["tok"], found["word"], len(words))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word."""
        ranks = self.table.ranks
        out = [ranks[w].to_bytes(4, "little") if w in ranks else b"" for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        short = [i for i in todo if len(words[i]) <= LONG_WORD]
        sizes = np.array([len(words[i]) ** 2 // 2 for i in short], np.int64)
        bounds = _cut(sizes, 1, _ROWS_A_CALL)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if part := short[lo:hi]:
                start_rows = _rows([words[i] for i in part], self.table.byte_ids)  # noqa: F841
                found = self.db.execute(_ENCODE).fetchnumpy()
                for i, ids in zip(part, _split(found["tok"], found["word"], len(part)), strict=True):
                    out[i] = ids
        long = [i for i in todo if len(words[i]) > LONG_WORD]
        bounds = _cut(np.array([len(words[i]) for i in long], np.int64), 1, 200_000)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if part := long[lo:hi]:
                for i, ids in zip(part, self._long([words[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text, and the bytes that these ids stand for."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.ids) > self.max_words:  # words in use move on from the older half, the rest are forgotten
            self.older, self.ids, self.bytes = (self.ids, self.bytes), {}, {}
        new, (old_ids, old_bytes) = [], self.older
        for w in set().union(*split) - self.ids.keys() if split else ():
            if w in old_ids:
                self.ids[w], self.bytes[w] = old_ids[w], old_bytes[w]
            else:
                new.append(w)
        found = self.encode_words([w.encode() for w in new])
        self.ids.update(zip(new, found, strict=True))
        self.bytes.update(zip(new, self.decode(found), strict=True))
        ids = [b"".join(map(self.ids.__getitem__, s)) for s in split]
        decoded = [b"".join(map(self.bytes.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > LONG_WORD:
                del self.ids[w], self.bytes[w]
        return ids, decoded

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_decode(texts)[0]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        out = [b""] * len(ids)
        bounds = _cut(np.array([len(x) // 4 for x in ids], np.int64), 1, 1_000_000)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            flat = np.frombuffer(b"".join(ids[lo:hi]), "<u4")
            owner = np.repeat(np.arange(lo, hi, dtype=np.int32), [len(x) // 4 for x in ids[lo:hi]])
            token_rows = pa.table({"word": owner, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat.astype(np.int32)})  # noqa: F841
            found = self.db.execute(_DECODE).fetchnumpy()
            chars = found["chars"].tolist()
            data, at = "".join(chars).encode("utf-16-le")[::2], 0
            for i, n in zip(found["word"].tolist(), map(len, chars), strict=True):
                out[i] = data[at : at + n]
                at += n
        return out


def _split(tok: np.ndarray, word: np.ndarray, words: int) -> list[bytes]:
    """Ids by word, as bytes, of rows in the order of words and positions."""
    data, ends = np.asarray(tok).astype("<u4").tobytes(), 4 * np.bincount(word, minlength=words).cumsum()
    ends = ends.tolist()
    return [data[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


_BPE: dict[tuple[str, str], SqlBpe] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (bytes of little-endian unsigned 32-bit), decoded (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _BPE.setdefault((ranks_path, pattern), None) or SqlBpe(ranks_path, pattern)
        _BPE[ranks_path, pattern] = bpe
        for b in batches:
            for part, texts in in_chunks(b, 1, _CHUNK_CHARS):
                ids, decoded = bpe.encode_decode(texts)
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of :func:`encode_decode`, taken in the JVM."""
    return encoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
