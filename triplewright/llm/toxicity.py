"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Texts are cut into windows of ``WINDOW`` words, one after another; the words are the runs without white space,
lower-cased, and all of them count. One dictionary is trained on the toxic texts of the sample, one on the
ordinary ones, and a background of ordinary text follows either: what ordinary texts say anyway is found there
and costs the same, so the compressed lengths of a window differ by what only one of the dictionaries holds. A
window's evidence is its length under the ordinary dictionary less that under the toxic one. A text is described
by its three strongest windows, its mean evidence, and how many windows reach 1, 2, 3 and 4 bytes, by count and
by share; a logistic calibration on labelled texts that shaped neither dictionary turns this into a score.

The classifier is fitted on a bounded sample of the labelled rows: up to ``SAMPLE_PER_LABEL`` texts of each
label, those with the smallest hash of their id, and fewer where they would exceed about ``SAMPLE_BYTES`` bytes.
Scores read every whole text.

Defined results: a null text counts as empty; a text without words has one window of evidence
0; without labelled texts of both kinds every score is 0; of sampled rows with one text the first by id counts;
a very long text is scored window by window, a very long word is a window's word like others; repeated rows get
equal scores; an empty table gives an empty table; other columns are ignored; a label row without a document is
not used.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_LABEL = 3000
SAMPLE_BYTES = 24_000_000  # of text, for each label
DICTIONARY_SHARE = 0.65  # of the sample; the rest calibrates
DICTIONARY_BYTES = 32_768
BACKGROUND_BYTES = 8_000_000
WINDOW = 16
TRAIN_WINDOW = 8
LEVEL = 9
PAD = b" " * 16  # zstandard stores very short input as it is
PREDICT_AT = 0.7


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows_of(words: list[str], size: int = WINDOW) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor with raw content as its dictionary, matching three bytes and more, without any header that says the same each time."""
    lean = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=3, **lean)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)


def train_dictionary(windows: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the windows themselves as raw content where there are too few to train on."""
    total, least = sum(map(len, windows)), size
    while least >= 1024:
        if total >= 8 * least:
            try:
                return zstandard.train_dictionary(least, windows)
            except zstandard.ZstdError:
                pass
        least //= 2
    return zstandard.ZstdCompressionDict(b"".join(windows)[-size:] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class ToxicityModel:
    """Both dictionaries have one length, so the background lies equally far from a window."""

    toxic: bytes
    ordinary: bytes
    background: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.m = model
        self.toxic, self.ordinary = (compressor(d + model.background) for d in (model.toxic, model.ordinary))

    def evidence(self, text: str) -> np.ndarray:
        """Bytes by which the toxic dictionary is the better one, for each window."""
        data = [PAD + w.encode() + b" " for w in windows_of(words_of(text))]
        return np.array([len(self.ordinary.compress(d)) - len(self.toxic.compress(d)) for d in data] or [0], float)

    def describe(self, text: str) -> list[float]:
        e = self.evidence(text)
        top = np.sort(np.concatenate([e, np.zeros(3)]))[::-1][:3]
        counts = np.array([(e >= k).sum() for k in (1, 2, 3, 4)])
        return [*top, *np.log1p(counts), *(100 * counts / (len(e) + 8)), e.mean(), np.log1p(len(e))]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.describe(t) for t in texts]).reshape(len(texts), -1)
        return _sigmoid(np.c_[(x - self.m.mean) / self.m.spread, np.ones(len(x))] @ self.m.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) / len(y) + ridge * w)
    return w


def train(sample: pd.DataFrame, share: float | None = None) -> ToxicityModel | None:
    """A model from rows (doc_id, text, toxic); None without texts of both labels.

    ``share``: toxic rows among all labelled rows, to undo the sample's different share. Copies count once.
    """
    sample = sample.sort_values(["doc_id", "text"]).drop_duplicates("text")
    draw = np.array([zlib.crc32(f"dictionary {i}".encode()) / 2**32 for i in sample.doc_id])
    shaping, rest = sample[draw < DICTIONARY_SHARE], sample[draw >= DICTIONARY_SHARE]
    if min(rest.toxic.sum(), (1 - rest.toxic).sum()) < 5:  # too few rows to keep a part aside
        shaping = rest = sample
    if shaping.toxic.nunique() < 2:
        return None
    texts = {k: [words_of(t) for t in g] for k, g in shaping.groupby("toxic").text}
    order = np.random.default_rng(0)
    dicts = {}
    for k, g in texts.items():
        windows = [x for t in g for x in windows_of(t, TRAIN_WINDOW)]
        dicts[k] = train_dictionary([f" {windows[i]} ".encode() for i in order.permutation(len(windows))]).as_bytes()
    size = max(map(len, dicts.values()))
    toxic, ordinary = (b" " * (size - len(dicts[k])) + dicts[k] for k in (1, 0))
    background = " ".join(" ".join(t) for t in texts[0]).encode()[-BACKGROUND_BYTES:]
    model = ToxicityModel(toxic, ordinary, background, np.zeros(1), np.ones(1), np.zeros(1))
    scorer = Scorer(model)
    x = np.array([scorer.describe(t) for t in rest.text])
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    y = rest.toxic.to_numpy(float)
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.weights = _logistic(np.c_[(x - model.mean) / model.spread, np.ones(len(x))], y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel | None:
    """Fit on labels (doc_id, toxic) and their documents. Only sampled ids, at most about 2 ``per_label``, are broadcast."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    cut = F.when(F.col("toxic") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labels.where(draw < cut)), "doc_id")
    held = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    for k, n in held.items():
        if n > SAMPLE_BYTES:
            sample = sample.where((F.col("toxic") != k) | (draw < min(1.0, per_label / counts[k]) * SAMPLE_BYTES / n))
    return train(sample.toPandas(), counts[1] / (counts[0] + counts[1]))


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 from ``PREDICT_AT`` on)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    predicted = (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score")).select("doc_id", "score", predicted)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.record_batch([part.column(0), pa.array(_SCORERS[key].score([t or "" for t in part.column(1).to_pylist()]))], ["doc_id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, score double").select("doc_id", "score", predicted)
