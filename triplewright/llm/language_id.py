"""Language identification with language-bitmask n-gram filters.

Training takes letter n-grams (3 and 4, words padded with one blank each side) of labelled texts. The
n-grams that a language shows at least ``min_count`` times go into that language's Bloom filter. The
filters are bit-sliced: slot i holds one bit per language, so the AND of an n-gram's slots is the set of
all languages whose filter contains it. A text's answer comes from per-language popcounts over its
n-grams, corrected for the false-positive rate that each filter's fill gives.

The classifier is fitted on a bounded sample of the labelled rows: about ``SAMPLE_PER_LANG`` texts of each
language, the ones with the smallest hash of their id (whole texts). Predictions read every whole text.

Defined results: ``und`` with score 0 for a null text or one without letters, and for every text when nothing
could be learned; a text with letters but no known n-gram gets the language with most labelled rows, with score and
coverage 0; ties go to that language too; a very long text or token is read whole, in time and memory linear in
its length; ids, labels and sources play no part in a prediction; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_LANG = 1500
MIN_COUNT = 3
SLOT_BITS = 18
HASHES = 3
MIN_COVERAGE = 0.2

_CACHE_WORDS = 200_000
_LONG_TOKEN = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def ngram_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the letter 3- and 4-grams of each token, and the token each belongs to.

    Characters other than letters are dropped first; a token's letters are padded with a blank on each
    side, so "von" has " vo", "von", "on " and " von", "von ".
    """
    padded = [f" {t if t.isalpha() else ''.join(filter(str.isalpha, t))} " for t in tokens]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    owner = np.repeat(np.arange(len(padded)), sizes)
    hashes, owners = [], []
    for n in (3, 4):
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * _MIX[0]
            h ^= h >> np.uint64(32)
        inside = owner[: len(h)] == owner[n - 1 :]
        hashes.append(h[inside])
        owners.append(owner[: len(h)][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        h = hashes * _MIX[k] + np.uint64(k)
        yield ((h ^ (h >> np.uint64(29))) * _MIX[(k + 1) % 3] >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``slots[w, i]`` holds a bit for each of languages 64 w to 64 w + 63."""

    langs: list[str]
    slots: np.ndarray
    bits: int
    fp_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], order: list[str] | None = None, bits: int = SLOT_BITS) -> LanguageFilters:
        """Filters of each language's n-grams; of languages with equal popcounts the one first in ``order`` wins."""
        langs = [x for x in order or sorted(grams) if x in grams]
        need = max([len(g) for g in grams.values()], default=0)
        while (1 << bits) < 8 * need:  # fill stays under a third
            bits += 1
        slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
        for i, lang in enumerate(langs):
            bit = np.uint64(1 << (i % 64))
            for at in _slots(grams[lang], bits):
                slots[i // 64, at] |= bit
        fill = np.array([np.mean(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))])
        return cls(langs, slots, bits, fill**HASHES)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """(n-grams, languages) of 0 and 1: the languages whose filter contains each n-gram."""
        if not self.langs:
            return np.zeros((len(hashes), 0), np.int64)
        masks = np.full((len(self.slots), len(hashes)), ~np.uint64(0))
        for at in _slots(hashes, self.bits):
            masks &= self.slots[:, at]
        return np.stack([masks[i // 64] >> np.uint64(i % 64) & np.uint64(1) for i in range(len(self.langs))], 1).astype(np.int64)


class Predictor:
    """Popcounts per distinct token are kept (bounded), so a text costs one look-up for each token."""

    def __init__(self, filters: LanguageFilters):
        self.f, self.width = filters, len(filters.langs) + 1
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = np.zeros((1024, self.width), np.int64)

    def count(self, tokens: list[str]) -> np.ndarray:
        """For each token: popcount per language, then the number of its n-grams."""
        hashes, owner = ngram_hashes(tokens)
        out = np.zeros((len(tokens), self.width), np.int64)
        if len(hashes):
            hit = np.concatenate([self.f.hits(hashes), np.ones((len(hashes), 1), np.int64)], 1)
            for k in range(self.width):
                out[:, k] = np.bincount(owner, hit[:, k], len(tokens))
        return out

    def popcounts(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > _CACHE_WORDS:
            self.clear()
        split = [tokens_of(t) for t in texts]
        new = [t for t in set().union(*split) if t not in self.index and len(t) <= _LONG_TOKEN] if split else []
        if new:
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            while len(self.counts) < len(self.index):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[at : at + len(new)] = self.count(new)
        out = np.zeros((len(texts), self.width), np.int64)
        for i, tokens in enumerate(split):
            try:
                at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
            except KeyError:
                out[i] += self.count([t for t in tokens if len(t) > _LONG_TOKEN]).sum(0)
                at = np.array([self.index[t] for t in tokens if len(t) <= _LONG_TOKEN], np.int64)
            out[i] += self.counts[at].sum(0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage (the winner's corrected share of n-grams) of each text."""
        if not self.f.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts = self.popcounts(texts)
        grams, hits = counts[:, -1:].astype(float), counts[:, :-1].astype(float)
        right = np.clip((hits - grams * self.f.fp_rate) / (1 - self.f.fp_rate), 0, None)
        best = right.argmax(1)
        top = right[np.arange(len(texts)), best]
        rest = np.sort(right, 1)[:, -2] if right.shape[1] > 1 else np.zeros(len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(top > 0, np.clip(top / (top + rest), 0, 1), 0.0)
            cover = np.where(grams[:, 0] > 0, np.clip(top / grams[:, 0], 0, 1), 0.0)
        names = [self.f.langs[b] if n else "und" for b, n in zip(best, grams[:, 0], strict=True)]  # every letter is in an n-gram
        return names, score, cover


def sample_per_lang(labelled: DataFrame, counts: list[tuple[str, int]], per_lang: int) -> DataFrame:
    """About ``per_lang`` rows (doc_id, text, lang) of each language: ids hashed under a per-language cut-off.

    The cut-offs come from the exact counts of all labelled rows, so the filter needs no shuffle of texts.
    """
    cuts = {lang: min(1.0, per_lang / n) for lang, n in counts}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    cut = F.lit(0.0)
    for lang, share_ in cuts.items():
        cut = F.when(F.col("lang") == lang, F.lit(share_)).otherwise(cut)
    return labelled.where(draw < cut)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            hashes, _ = ngram_hashes([t for x, s in zip(langs, texts, strict=True) if x == lang and s for t in tokens_of(s)])
            keys, n = np.unique(hashes, return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, min_count: int = MIN_COUNT) -> LanguageFilters:
    """Filters from rows (doc_id, text, lang); rows without text or lang are not used."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = sorted(((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0]))  # one row per language
    rows = sample_per_lang(labelled, counts, per_lang)
    counted = rows.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    kept = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("lang", "gram").toPandas()  # bounded by the sample
    return LanguageFilters.build({lang: g["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in kept.groupby("lang")}, [lang for lang, _ in counts])


_PREDICTORS: dict[str, Predictor] = {}


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, coverage."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # a few MB, fixed by the sample
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PREDICTORS:  # Python workers are reused: the tokens they have seen stay
            _PREDICTORS.clear()
            _PREDICTORS[key] = Predictor(shared.value)
        p = _PREDICTORS[key]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lang, score, cover = p.predict([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], ["doc_id", "lang_pred", "score", "coverage"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, coverage double")


def keep_identified(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language: not ``und``, and the language's filter holds at
    least ``min_coverage`` of its n-grams."""
    shared, at = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(shared.value)
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                lang, _, cover = p.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([x != "und" and c >= min_coverage for x, c in zip(lang, cover, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
