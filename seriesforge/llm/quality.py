"""Quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text is cut into blocks of ``BLOCK`` bytes, so that a dictionary matters as
much at the end of a long text as in a short one.  Each block is compressed with
either dictionary.  The difference of the two sums, divided by the text's bytes,
is the normalised compressed-size difference, to which a short average text is
added; a logistic curve fitted on labelled
texts that no dictionary was built from, weighted to the classes' true shares,
turns it into the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text
from seriesforge.llm._spark import ship_package

#: Bound of the labelled sample: whole texts of each class; half build dictionaries, half calibrate.
SAMPLE = 1200
DICTIONARY_BYTES = 64 << 10
BLOCK = 768
#: Bytes of an average text that are added to each text.
PRIOR_BYTES = 128
LEVEL = 3


class Model:
    """Two dictionaries, the mean difference of all texts, and the curve ``1 / (1 + exp(-(a + b x)))``."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.mean, self.curve = good, bad, 0.0, (0.0, 0.0)
        self._codecs = None

    def __getstate__(self):
        return self.good, self.bad, self.mean, self.curve

    def __setstate__(self, state):
        self.good, self.bad, self.mean, self.curve = state
        self._codecs = None

    def codecs(self):
        if self._codecs is None:
            self._codecs = [_codec(self.good), _codec(self.bad)]
        return self._codecs

    def normalised(self, saved: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Differences over bytes; ``PRIOR_BYTES`` of an average text are added, so that a few words decide little."""
        return (saved + PRIOR_BYTES * self.mean) / (size + PRIOR_BYTES)

    def score(self, saved: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b = self.curve
        x = self.normalised(saved, size)
        return 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))


def _codec(content: bytes):
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(codecs, text: memoryview) -> int:
    """Bytes with the bad dictionary minus bytes with the good one."""
    good, bad = codecs
    total = 0
    for a in range(0, len(text), BLOCK):
        part = text[a : a + BLOCK]
        total += len(bad.compress(part)) - len(good.compress(part))
    return total


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary content of about DICTIONARY_BYTES, of samples spread over all texts."""
    samples = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        # too little text to train on: the text itself
        return b"".join(samples)[:DICTIONARY_BYTES]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression by Newton steps, lightly damped."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([np.ones(len(x)), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (weight * (y - p)) - 1e-3 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def train(good: list[bytes], bad: list[bytes], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """Fit on texts of each class in a fixed order: even ones build the dictionaries, odd ones calibrate."""
    model = Model(_dictionary(good[::2]) if good else b"", _dictionary(bad[::2]) if bad else b"")
    held = [good[1::2], bad[1::2]]
    if not all(held) or not model.good or not model.bad:
        p = min(max(shares[0] / (sum(shares) or 1), 1e-6), 1 - 1e-6)
        model.curve = (float(np.log(p / (1 - p))), 0.0)
        return model
    saved = np.array([difference(model.codecs(), memoryview(t)) for t in held[0] + held[1]], float)
    size = np.array([len(t) for t in held[0] + held[1]], float)
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    weight = np.repeat([shares[0] / len(held[0]), shares[1] / len(held[1])], [len(held[0]), len(held[1])])
    weight *= len(y) / weight.sum()
    model.mean = float((weight * saved / np.maximum(size, 1)).mean())
    model.curve = fit_curve(model.normalised(saved, size), y, weight)
    return model


def fit(labels: DataFrame, texts: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labels(doc_id, label)`` with labels 1 and 0 and ``texts(doc_id, text)``: about ``sample`` whole texts of each label, by the ids' hashes.

    The classes' shares are counted over all labels.  Only the sampled ids, a
    bounded number, are looked up among the texts.  Of contradicting labels of one id the greater counts.
    """
    counts = {r["label"]: r["count"] for r in labels.where("label in (0, 1)").groupBy("label").count().collect()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    cut = F.lit(0)
    for label, n in counts.items():
        cut = F.when(F.col("label") == label, min(1 << 30, int(1.3 * (sample + 20) / n * (1 << 30)) + 1)).otherwise(cut)
    chosen = labels.where(h < cut).groupBy("doc_id").agg(F.max("label").alias("label"), F.max(h).alias("h"))
    rows = texts.where("text is not null").join(F.broadcast(chosen), "doc_id").select("label", "h", "text").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("text", "ascending")])
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for label, t in zip(rows.column("label").to_pylist(), rows.column("text").to_pylist(), strict=True):
        if len(found[label]) < sample:
            found[label].append(t.encode())
    return train(found[1], found[0], (float(counts.get(1, 0)), float(counts.get(0, 0))))


@_text.trims
def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    codecs = model.codecs() if model.good and model.bad else None
    for batch in batches:
        data, off = _text.utf8(batch.column("text"))
        view = memoryview(data)
        saved = np.array([difference(codecs, view[a:b]) if codecs else 0 for a, b in zip(off[:-1], off[1:], strict=True)], float)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(saved, np.diff(off).astype(float)), pa.float64())], names=[*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (one named text) and the score of each text, 0 to 1, higher where label 1 is likelier.

    A null text counts as empty; an empty text scores as an average one.
    Repeated rows and empty tables pass as they are; a column named score is
    replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda it: _score(it, shared), f"{kept}, score double")
