"""Benchmark decontamination by template windows and slot consistency.

Texts and benchmark items become runs of letters and digits.  Those with a digit
and number words turn into a number slot, capitalised ones into a name slot,
units of measure into a unit slot; the others stay, lower-cased.  Windows of
``WINDOW`` template tokens, half of them literal at least, are joined by hash.
Matches of one item along one diagonal (place in the text minus place in the item) are
compared slot by slot: a value of the item must stand for one value of the text.
A text leaks an item where consistent windows cover ``LEAST_COVERAGE`` of the
item's tokens, so also when numbers, names or units were exchanged.

Beside the templates stand the lower-cased tokens as they are, in windows of the same
length: exact copies of items of numbers and names, of items too short for a window, and
copies in capitals or title case, whose words are all name slots, are found by these.  Exact runs of ``LEAST_RUN`` tokens of an
item leak it whatever share of it they are.

The benchmark is read in blocks of a bounded number of characters, each of which
is hashed on every task; texts are read once for each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from seriesforge.llm import _text
from seriesforge.llm._spark import ship_package

WINDOW = 8
LEAST_COVERAGE = 0.5
LEAST_AGREEMENT = 0.75
#: Tokens of an exact run that leaks an item of any length.
LEAST_RUN = 50
#: Bound of the benchmark text that is sent to tasks at once.
BLOCK_CHARS = 8_000_000

# Number words and units that become slots.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons mph kph hz khz mhz ghz kb mb gb tb"
).split()


def _hashes(of: list[str]) -> np.ndarray:
    data, off = _text.utf8(pa.array(of, pa.string()))
    return np.sort(_text.words(data, off, sep=_text.NOT_ALNUM)[2])


_NUMBERS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
NUMBER, NAME, UNIT = (np.uint64(0x1F83D9ABFB41BD6B + k) for k in range(3))


class Template:
    """Template tokens of consecutive rows."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.starts, self.ends, h, self.first = _text.words(data, off, sep=_text.NOT_ALNUM)
        self.plain = h
        if len(h):
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            number = (digits[self.ends] > digits[self.starts]) | _among(h, _NUMBERS)
            lead = data[self.starts]
            second = data[np.minimum(self.starts + 1, len(data) - 1)]
            # two-byte capitals: Latin-1, then Greek and Cyrillic ones
            name = ((lead >= 65) & (lead < 91)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) | ((lead == 0xCE) & (second >= 0x91) & (second <= 0xA9)) | ((lead == 0xD0) & (second >= 0x80) & (second <= 0xAF))
            unit = _among(h, _UNITS) & ~number
            h = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, h)))
        self.tokens = h
        self.literal = (h != NUMBER) & (h != NAME) & (h != UNIT)
        self.windows = _text.windows(h, WINDOW)
        plain = np.concatenate([[0], np.cumsum(self.literal)])
        self.telling = plain[WINDOW:] - plain[:-WINDOW] >= WINDOW // 2 if len(h) >= WINDOW else np.zeros(0, bool)

    def same(self, i: int, other: Template, j: int) -> bool:
        """Whether two tokens are alike but for capitals."""
        return self.plain[i] == other.plain[j]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _among(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, h)
    at[at == len(of)] = 0
    return of[at] == h if len(of) else np.zeros(len(h), bool)


class Index:
    """Windows of benchmark items by hash.  An item shorter than a window is one window by itself."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        data, off = _text.utf8(pa.array(texts, pa.string()))
        self.template = t = Template(data, off)
        self.size = np.diff(t.first)
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        # by length of window: those that are compared as they are
        self.exact: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        plain = _text.windows(t.plain, WINDOW)
        for i in range(len(ids)):
            s, e = int(t.first[i]), int(t.first[i + 1])
            if 0 < e - s < WINDOW:
                if t.literal[s:e].sum() * 2 >= e - s and e - s >= 4:
                    self.short[e - s][int(_text.windows(t.tokens[s:e], e - s)[0])].append(i)
                self.exact[e - s][int(_text.windows(t.plain[s:e], e - s)[0])].append((i, 0))
                continue
            for p in range(s, e - WINDOW + 1):
                if t.telling[p]:
                    self.at[int(t.windows[p])].append((i, p - s))
                self.exact[WINDOW][int(plain[p])].append((i, p - s))
        self.keys = np.sort(np.array(list(self.at), np.uint64))
        self.exact_keys = {n: np.sort(np.array(list(of), np.uint64)) for n, of in self.exact.items()}

    def exact_hits(self, t: Template, known: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: places of t whose window is known as it is, but not as a template, and its hash."""
        out = {}
        for n, keys in self.exact_keys.items():
            w = _text.windows(t.plain, n)
            other = np.ones(len(w), bool)
            if n == WINDOW:
                other[known] = False
            at = np.flatnonzero(other)
            at = at[_among(w[at], keys)]
            out[n] = at, w[at]
        return out

    def leaks(self, t: Template, a: int, b: int, hits: np.ndarray, exact: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[object, float, float]]:
        """Items that row tokens a..b leak: id, coverage, agreement of slots.  hits, exact: places whose window is known, as a template or as it is."""
        diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p in hits.tolist():
            for item, q in self.at[int(t.windows[p])]:
                diagonals[item, p - q].update(range(q, q + WINDOW))
        for n, of in self.short.items():
            if b - a >= n:
                w = _text.windows(t.tokens[a:b], n)
                for p in np.flatnonzero(_among(w, np.sort(np.array(list(of), np.uint64)))).tolist():
                    for item in of[int(w[p])]:
                        diagonals[item, a + p].update(range(n))
        covered: dict[int, set[int]] = defaultdict(set)
        runs: dict[tuple[int, int], set[int]] = defaultdict(set)
        agreement: dict[int, float] = {}
        for (item, d), places in sorted(diagonals.items()):
            share = self._agreement(t, item, d, places)
            if share >= LEAST_AGREEMENT:
                covered[item] |= places
                agreement[item] = max(share, agreement.get(item, 0.0))
                runs[item, d] |= places
        for n, (at, keys) in exact.items():
            # a window must not run into the next row
            first, last = np.searchsorted(at, [a, max(a, b - n + 1)]).tolist()
            for p, key in zip(at[first:last].tolist(), keys[first:last].tolist(), strict=True):
                for item, q in self.exact[n][key]:
                    base = int(self.template.first[item]) + q
                    if all(t.same(p + k, self.template, base + k) for k in range(n)):
                        covered[item].update(range(q, q + n))
                        agreement[item] = 1.0
                        runs[item, p - q].update(range(q, q + n))
        long = {item for (item, d), places in runs.items() if len(places) >= LEAST_RUN and self._run(t, item, d, places) >= LEAST_RUN}
        return [
            (self.ids[i], len(c) / int(self.size[i]), agreement[i]) for i, c in sorted(covered.items()) if i in long or len(c) >= LEAST_COVERAGE * int(self.size[i])
        ]

    def _run(self, t: Template, item: int, d: int, places: set[int]) -> int:
        """The longest run of places at which text and item have the same token."""
        base, best, length, last = int(self.template.first[item]), 0, 0, -2
        for q in sorted(places):
            length = (length + 1 if q == last + 1 else 1) if t.same(d + q, self.template, base + q) else 0
            best, last = max(best, length), q
        return best

    def _agreement(self, t: Template, item: int, d: int, places: set[int]) -> float:
        """The share of slots whose value in the text is the usual one for their value in the item; 1 without slots."""
        own, base = self.template, int(self.template.first[item])
        values: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
        for q in places:
            if not own.literal[base + q]:
                values[int(own.tokens[base + q]), own.word(base + q)][t.word(d + q)] += 1
        slots = sum(sum(c.values()) for c in values.values())
        return sum(max(c.values()) for c in values.values()) / slots if slots else 1.0


def leaks_of(column, index: Index) -> Iterator[list[tuple[object, float, float]]]:
    """For each text the items it leaks."""
    for a, b, data, off in _text.blocks(column):
        t = Template(data, off)
        known = np.flatnonzero(_among(t.windows, index.keys) & t.telling) if len(index.keys) else np.zeros(0, np.int64)
        exact = index.exact_hits(t, known)
        for i in range(b - a):
            s, e = int(t.first[i]), int(t.first[i + 1])
            # a window must not run into the next row
            hits = known[np.searchsorted(known, s) : np.searchsorted(known, max(s, e - WINDOW + 1))]
            own = any(np.searchsorted(at, s) < np.searchsorted(at, e) for at, _ in exact.values())
            yield index.leaks(t, s, e, hits, exact) if len(hits) or own or index.short else []


@_text.trims
def _find(batches: Iterator[pa.RecordBatch], shared, id_type) -> Iterator[pa.RecordBatch]:
    index = Index(*shared.value)
    for batch in batches:
        rows, items, coverage, agreement = [], [], [], []
        for i, found in enumerate(leaks_of(batch.column("text"), index)):
            for item, c, s in found:
                rows.append(i)
                items.append(item)
                coverage.append(c)
                agreement.append(s)
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": pa.array(items, id_type), "coverage": pa.array(coverage, pa.float64()), "agreement": pa.array(agreement, pa.float64())}
        )


@_text.trims
def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index = Index(*shared.value)
    for batch in batches:
        yield batch.filter(pa.array([not found for found in leaks_of(batch.column("text"), index)], pa.bool_()))


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded size; null texts are no items."""
    ids, texts, size = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, coverage, agreement)`` of each text of ``docs(doc_id, text)`` and each item of ``benchmark(item_id, text)`` that it leaks.

    Null and empty texts leak nothing; null ids are carried; repeated rows and
    repeated items give repeated results; an empty side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type.simpleString()}, coverage double, agreement double"
    arrow = to_arrow_type(id_type)
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(lambda it, s=shared: _find(it, s, arrow), schema))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (one named text) that leak no item, with all columns."""
    spark = docs.sparkSession
    ship_package(spark)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        docs = docs.mapInArrow(lambda it, s=shared: _clean(it, s), docs.schema)
    return docs
