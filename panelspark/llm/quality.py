"""Quality classifier by compression with zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import text_of, texts


@dataclass(frozen=True)
class Settings:
    """``rows_per_class`` and ``bytes_per_row`` bound the labelled sample that fits the model (not what
    is scored): at most 2 x 3000 rows, of each at most 6000 code points from its middle."""

    rows_per_class: int = 3000
    chars_per_row: int = 6000
    dictionary_bytes: int = 112 << 10
    chunk_bytes: int = 4 << 10
    level: int = 3


@dataclass(frozen=True)
class CompressionClassifier:
    """Two dictionaries and a logistic curve over compressed sizes."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    settings: Settings

    def measures(self, values: list[str]) -> np.ndarray:
        """A row for each text: the normalised difference ``(bytes with the bad dictionary - bytes with
        the good one) / bytes without any``, the same difference unnormalised on a logarithmic scale
        (in a short text a few bytes say little), and two terms that tell how far the text packs by
        itself, without which a repeated word, tiny under either dictionary, has no place on the curve.

        A text is cut into chunks that are packed apart, so that the dictionaries count in every part
        of a long text; the whole text is read. An empty text has zeros.
        """
        s = self.settings
        packers = [
            zstandard.ZstdCompressor(level=s.level, dict_data=d, write_content_size=False, write_dict_id=False)
            for d in (self._dictionary(self.bad), self._dictionary(self.good), None)
        ]
        out = np.zeros((len(values), 5))
        out[:, 4] = 1
        for i, value in enumerate(values):
            raw = value.encode("utf-8", "replace")
            sizes = [0, 0, 0]
            for at in range(0, len(raw), s.chunk_bytes):
                part = raw[at : at + s.chunk_bytes]
                for k, packer in enumerate(packers):
                    sizes[k] += len(packer.compress(part))
            if raw:
                d, ratio = sizes[0] - sizes[1], math.log(sizes[2] / len(raw))
                out[i, :4] = d / sizes[2], math.copysign(math.log1p(abs(d)), d), ratio, ratio * ratio
        return out

    def _dictionary(self, data: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=self.settings.level)
        return d

    def scores(self, values: list[str]) -> np.ndarray:
        z = np.clip(self.measures(values) @ np.array(self.weights), -500, 500)
        return 1 / (1 + np.exp(-z))


def _sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, settings: Settings) -> tuple[list[str], list[str]]:
    """Texts of either class with the smallest hashes of their key, in that order.

    The sample is drawn on keys; its texts are then looked up by the drawn keys alone."""
    n = F.length("__text")
    start = F.greatest(F.lit(1), F.floor((n - settings.chars_per_row) / 2) + 1).cast("int")
    order = F.sha1(F.coalesce(F.col(key).cast("string"), F.lit("")))
    there = docs.filter(F.length(text) > 0).select(key)
    known = labels.select(key, F.col(label).cast("int").alias("__label")).join(there, key, "left_semi").withColumn("__order", order)
    drawn = [known.filter(F.col("__label") == v).orderBy("__order", key).limit(settings.rows_per_class) for v in (1, 0)]
    keys = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 x rows_per_class rows
    rows = docs.select(F.col(key), text_of(text).alias("__text")).join(keys, key)
    rows = rows.select("__label", "__order", F.substring("__text", start, F.lit(settings.chars_per_row)).alias("__text"))
    found = sorted(map(tuple, rows.collect()), key=lambda r: (r[1], r[2]))
    return [t for v, _, t in found if v == 1], [t for v, _, t in found if v == 0]


def _dictionary(values: list[str], settings: Settings) -> bytes:
    """A trained zstandard dictionary, or the raw text where there is too little to train one."""
    parts = [r[at : at + settings.chunk_bytes] for r in (v.encode("utf-8", "replace") for v in values) for at in range(0, len(r), settings.chunk_bytes)]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-settings.dictionary_bytes :] or b" "


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton steps, with Platt's softened targets and a small ridge."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    u, w = x / scale, np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        hessian = (u * (p * (1 - p))[:, None]).T @ u + np.diag(ridge)
        step = np.linalg.solve(hessian, u.T @ (target - p) - ridge * w)
        w = w + step * min(1.0, 4 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    settings: Settings = Settings(),
) -> CompressionClassifier:
    """Fit on the documents with label 1 (good) and 0 (bad); other labels and empty texts are left out.

    Two thirds of the bounded sample train the dictionaries, the last third calibrates. With fewer
    than three rows of a class the score is that class share, the same for every text.
    """
    good, bad = _sample(docs, labels, label, key, text, settings)
    if min(len(good), len(bad)) < 3:
        odds = math.log((len(good) + 1) / (len(bad) + 1))
        return CompressionClassifier(b" ", b" ", (0.0, 0.0, 0.0, 0.0, odds), settings)
    cut1, cut0 = -(-2 * len(good) // 3), -(-2 * len(bad) // 3)
    model = CompressionClassifier(_dictionary(good[:cut1], settings), _dictionary(bad[:cut0], settings), (0.0,) * 5, settings)
    x = model.measures(good[cut1:] + bad[cut0:])
    y = np.array([1] * (len(good) - cut1) + [0] * (len(bad) - cut0), float)
    return CompressionClassifier(model.good, model.bad, _calibrate(x, y), settings)


def add_score(docs: DataFrame, model: CompressionClassifier, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``: the model's probability of label 1. Only the text is looked at; null is empty text.

    No shuffle; an existing column ``name`` is replaced."""
    kept = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 112 KiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            score = pa.array(scorer.scores(texts(batch.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], score], [*kept, name])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], f"`{name}` double"])
    return docs.select(*kept).mapInArrow(run, schema)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor
