"""Language identification by prediction by partial matching with frozen statistics.

Each language has a context tree of bytes up to ``ORDER`` deep, with the counts
of what followed each context in its training texts.  A symbol is coded in the
longest context that has been seen; if it never followed there, an escape is
paid (method C: distinct followers against all occurrences) and the next shorter
context is tried; below order 0 all 256 bytes are equally likely.  Counts do not
change while scoring, so the code length of a byte depends on its context only:
the trees are compiled into one automaton over the union of contexts with a
table of code lengths for each (context, byte, language), and whole texts are
scored with array look-ups.  The language with the shortest total code wins.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text
from seriesforge.llm._spark import ship_package

#: Longest context in bytes.
ORDER = 3
#: Bound of the training sample: whole texts of each language, those of smallest hash, and of all languages together.
SAMPLE, SAMPLE_ALL = 150, 9600
#: Bound of the compiled tables, which are sent to all tasks: the order falls until they fit.
MODEL_BYTES = 1 << 28
#: Prediction for texts without a letter.
UNKNOWN = "und"
#: Occurrences that a context of three bytes or more needs to be kept in a tree.
LEAST_SEEN = 3


class Model:
    """Compiled trees: ``step[node, symbol]`` deepens a context by the byte before it, ``bits[node, symbol]`` has each language's code lengths."""

    def __init__(self, langs: list[str], symbol: np.ndarray, step: list[np.ndarray], bits: np.ndarray, first: np.ndarray):
        self.langs, self.symbol, self.step, self.bits, self.first = langs, symbol, step, bits, first


def _grams(texts: list[bytes], n: int, symbol: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the runs of n symbols inside texts; earlier bytes weigh less than later ones."""
    parts = []
    for t in texts:
        s = symbol[np.frombuffer(t, np.uint8)].astype(np.int64)
        if len(s) >= n:
            code = np.zeros(len(s) - n + 1, np.int64)
            for j in range(n):
                # the newest byte is the lowest digit, the oldest the highest
                code = code * size + s[j : len(s) - n + 1 + j]
            parts.append(code)
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Trees of each language's texts, compiled.  A text's start has shorter contexts."""
    langs = sorted(texts)
    seen = np.zeros(256, bool)
    for ts in texts.values():
        for t in ts:
            seen[np.frombuffer(t, np.uint8)] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    size = int(seen.sum()) + 1  # symbol 0: bytes that no training text has
    grams = {g: [_grams(texts[g], n, symbol, size) for n in range(1, order + 2)] for g in langs}
    # contexts of length n are the leading n symbols of grams of n + 1
    contexts = []
    for n in range(order + 1):
        found = []
        for g in langs:
            code, count = grams[g][n]
            c, at = np.unique(code // size, return_inverse=True)
            total = np.bincount(at, count, len(c))
            found.append(c[total >= (LEAST_SEEN if n > 2 else 1)])
        contexts.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))
    while order > 1 and sum(map(len, contexts)) * size * (len(langs) + 1) * 4 > MODEL_BYTES:
        order -= 1
        contexts = contexts[: order + 1]
    # a context's parent lacks its oldest byte, which is the highest digit
    first = np.cumsum([0, *map(len, contexts)])
    nodes = int(first[-1])
    bits = np.full((max(nodes, 1), size, len(langs)), 8.0, np.float32)
    for i, g in enumerate(langs):
        for n in range(order + 1):
            c = contexts[n]
            if not len(c):
                continue
            if n:
                parent = first[n - 1] + np.searchsorted(contexts[n - 1], c % size ** (n - 1))
                row = bits[parent, :, i].copy()
            else:
                row = np.full((len(c), size), 8.0, np.float32)
            code, count = grams[g][n]
            at = np.searchsorted(c, code // size)
            at[at == len(c)] = 0
            known = c[at] == code // size
            at, s, count = at[known], code[known] % size, count[known]
            total, kinds = np.bincount(at, count, len(c)), np.bincount(at, minlength=len(c))
            has = total > 0
            escape = np.zeros(len(c))
            escape[has] = np.log2((total[has] + kinds[has]) / kinds[has])
            row += escape[:, None].astype(np.float32)
            row[at, s] = np.log2((total[at] + kinds[at]) / count)
            bits[first[n] : first[n + 1], :, i] = row
    steps = []
    for n in range(order):
        # deepen contexts of length n by one older byte; -1 where the tree ends
        deeper, table = contexts[n + 1], np.full((len(contexts[n]), size), -1, np.int32)
        if len(deeper):
            table[np.searchsorted(contexts[n], deeper % size**n), deeper // size**n] = np.arange(first[n + 1], first[n + 2])
        steps.append(table)
    return Model(langs, symbol, steps, bits, first)


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each row in each language."""
    n, out = len(off) - 1, np.zeros((len(off) - 1, len(model.langs)))
    if not len(data) or not len(model.langs):
        return out
    s = model.symbol[data]
    # how many bytes of its row stand before each byte
    back = (np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))).astype(np.int32)
    node, size, grows = np.zeros(len(data), np.int32), np.int32(model.bits.shape[1]), None
    for depth, table in enumerate(model.step):
        if depth + 1 >= len(data):
            break
        # a byte whose context did not grow before is looked up too, in row 0, and left as it is
        grows = back > depth if grows is None else grows & (back > depth)
        row = (node - np.int32(model.first[depth])) * grows
        to = np.full(len(data), -1, np.int32)
        np.take(table.ravel(), row[depth + 1 :] * size + s[: -depth - 1], out=to[depth + 1 :], mode="clip")
        grows &= to >= 0
        np.copyto(node, to, where=grows)
    cost = model.bits.reshape(-1, len(model.langs)).take(node * size + s, axis=0)
    filled = np.flatnonzero(np.diff(off))
    out[filled] = np.add.reduceat(cost, off[:-1][filled], axis=0, dtype=np.float64)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Fit on ``docs(key, text, lang)``: for each non-null language ``sample`` whole texts by the keys' hashes, fewer where all languages would take more than ``SAMPLE_ALL``."""
    counts = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return train({}, order)
    sample = max(1, min(sample, SAMPLE_ALL // len(counts)))
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    # about 1.3 times as many as needed pass by hash; the smallest hashes stay
    wanted = [(F.col("lang") == g) & (h < min(1 << 30, int(1.3 * (sample + 20) / n * (1 << 30)) + 1)) for g, n in counts.items()]
    rows = docs.where(functools.reduce(operator.or_, wanted)).where("text is not null").select("lang", h.alias("h"), "text").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("h", "ascending"), ("text", "ascending")])
    texts: dict[str, list[bytes]] = {g: [] for g in counts}
    for g, t in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
        if len(texts[g]) < sample:
            texts[g].append(t.encode())
    return train(texts, order)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        lang, score = [], []
        texts = batch.column("text")
        for a, b, data, off in _text.blocks(texts, 1 << 19):
            bits = code_lengths(model, data, off)
            for i in range(b - a):
                t = texts[a + i].as_py()
                if not model.langs or not t or not _has_letter(t):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                x = bits[i] - bits[i].min()
                lang.append(model.langs[int(bits[i].argmin())])
                score.append(float(1 / np.exp2(-np.minimum(x, 1000)).sum()))
        yield pa.record_batch({**{n: batch.column(n) for n in batch.schema.names if n != "text"}, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})


def _has_letter(t: str) -> bool:
    return t.isalpha() or any(map(str.isalpha, t))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(..., text)`` with lang_pred and score in place of text, from the text alone.

    The score is the winner's share when code lengths are turned into
    probabilities.  A text that is null or has no letter gets ``und`` and 0.  Ties go to the
    first language by name; repeated rows and empty tables pass as they are; columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(lambda it: _score(it, shared), f"{kept}, lang_pred string, score double")
