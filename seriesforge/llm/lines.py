"""Line deduplication by a log-template tree of fixed depth, and of passages.

A line falls into a leaf of the tree by its token count and its ``LEADING`` first
tokens; tokens that hold a digit are variable wherever they stand.  A line that
recurs as it is, digits apart, in ``MIN_DOCS`` documents is a template.  The other
lines of a leaf are generalised: a token is literal where so many documents of the
leaf have it at that place, else the place is a variable field, and lines of equal
literals are one template.  A generalised template needs ``LITERALS`` literal
tokens and ``LITERAL_SHARE`` of all; a line of too few literals beside its digits
is matched as it is, digits included.  So every line has one template.  Where
``MIN_DOCS`` documents or more have a template, the one of smallest doc_id
keeps its lines and the others lose theirs.  All of this is grouped counts over
hashes; no leaf is gathered anywhere, and tokens are looked at in leaves that may
have a template only.

Passages are runs of ``PASSAGE`` tokens, wherever lines end; one that two documents
have stays in that of smallest doc_id.  Each run holds an anchor, the
``ANCHOR``-token run of least hash in it, so equal runs have equal anchors.  Of
anchors in several documents the tokens around them as far as any such run can
reach are compared by hash; where these agree as a whole, one document stands for
all.  Only what differs around an anchor is compared run by run.

Both are decided on the texts as they are given.  What goes from a document stands
in a document of smaller doc_id, so by induction in one that keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text
from seriesforge.llm._spark import Scratch, ship_package

MIN_DOCS = 3
LEADING = 3
#: Literal tokens of a generalised template, and their least share; lines below ``OWN_LITERALS`` keep their digits.
LITERALS, LITERAL_SHARE, OWN_LITERALS = 5, 0.7, 2
#: Tokens of a passage, which recurs from two documents on, and of an anchor.
PASSAGE = 50
ANCHOR = 16
#: Ids and anchors (8 bytes each) up to which they are broadcast.
MAX_BROADCAST = 1 << 20
#: Texts that go to Python at once.
TEXTS = 500
_REACH = PASSAGE - ANCHOR
#: Kinds of rows that are read from texts.
LINE, ANCHORED = "line", "anchor"
#: Of bytes: 1 a digit, 2 a letter, digit or byte of other scripts.
_CLASS = 2 * (~_text.NOT_ALNUM).astype(np.uint8)
_CLASS[48:58] |= 1
_VARIABLE = np.uint64(0x6A09E667F3BCC909)


class Layout:
    """Where lines of consecutive rows begin, and their tokens."""

    def __init__(self, data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.first = starts, ends, first
        rows = len(off) - 1
        breaks = np.flatnonzero(data == 10) + 1
        # each row's start opens a line, also that of an empty row
        begin = np.concatenate([off[:-1], breaks])
        owner = np.concatenate([np.arange(rows), np.searchsorted(off, breaks - 1, "right") - 1])
        order = np.lexsort((begin, owner))
        self.begin, self.row = begin[order], owner[order]
        self.cut = np.searchsorted(self.row, np.arange(rows + 1))
        # tokens of a line: those from its begin to the next line's
        self.token = np.searchsorted(self.starts, self.begin)
        self.n = np.append(self.token[1:], len(self.starts)) - self.token


class Lines(Layout):
    """Lines of consecutive rows with leaf and template hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: tuple | None = None):
        starts, ends, h, first = words or _text.words(data, off, lower=False)
        super().__init__(data, off, starts, ends, first)
        self.leaf = np.zeros(len(self.begin), np.uint64)
        self.line = np.zeros(len(self.begin), np.uint64)
        self.masked = h
        if not len(h):
            return
        # white space after a token is of no class
        has = np.bitwise_or.reduceat(_text.of_bytes(_CLASS, data), starts)
        digit = has & 1 > 0
        wordly = np.concatenate([[0], np.cumsum(has > 1)])
        self.masked = np.where(digit, _VARIABLE, h)
        plain = np.concatenate([[0], np.cumsum(~digit)])
        literal = plain[self.token + self.n] - plain[self.token]
        size = self.n.astype(np.uint64)
        few = literal < OWN_LITERALS
        value = np.where(np.repeat(few, self.n), h, self.masked) * _text.powers(len(h) + 1)[1 : len(h) + 1]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        self.line = _text.mix((run[self.token + self.n] - run[self.token]) * _text.inverse_powers(len(h) + 1)[self.token] + size)
        # a line without a letter or digit says nothing
        said = wordly[self.token + self.n] > wordly[self.token]
        self.line[~said] = 0
        grows = said & ~few & (self.n > LEADING) & (literal >= LITERALS)
        lead = size[grows]
        for k in range(LEADING):
            lead = lead + self.masked[self.token[grows] + k] * _text.powers(LEADING + 2)[k + 1]
        self.leaf[grows] = _text.mix(lead) | np.uint64(1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, TEXTS):
            yield whole.slice(first, TEXTS)


def _listed(place: np.ndarray, fresh: np.ndarray) -> pa.Array:
    """Places in lists, of which each begins at one of fresh."""
    return pa.ListArray.from_arrays(np.append(fresh, len(place)).astype(np.int32), place.astype(np.int32))


@_text.trims
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the wanted lines of each row."""
    for batch in _slices(batches):
        for a, b, data, off in _text.blocks(batch.column("text")):
            x = Lines(data, off)
            for i in range(b - a):
                s, e = x.cut[i], x.cut[i + 1]
                want = batch.column("lines")[a + i].values.to_numpy().view(np.uint64)
                _, once = np.unique(x.line[s:e], return_index=True)
                at = s + once[np.isin(x.line[s + once], want)]
                yield pa.record_batch({
                    "leaf": x.leaf[at].view(np.int64), "line": x.line[at].view(np.int64),
                    "tokens": pa.array([x.masked[x.token[k] : x.token[k] + x.n[k]].view(np.int64) for k in at], pa.list_(pa.int64())),
                })


def _sliding(g: np.ndarray, w: int, of) -> np.ndarray:
    """The least or greatest (``of``) of each w consecutive values."""
    m, k = g, 1
    while 2 * k <= w:
        m = of(m[:-k], m[k:])
        k *= 2
    return of(m[: len(g) - w + 1], m[w - k : len(g) - k + 1])


class Runs:
    """Hashes of token runs of consecutive rows, by prefix sums."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: tuple | None = None):
        self.starts, self.ends, h, self.first = words or _text.words(data, off, lower=False)
        n = len(h)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _text.powers(n + 1)[:n])])
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _text.mix((self.sums[b] - self.sums[a]) * _text.inverse_powers(len(self.sums))[a])

    def every(self, w: int) -> np.ndarray:
        n = len(self.sums) - w
        at = np.arange(max(0, n))
        return self.hashes(at, at + w)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors, and their hashes."""
        g = self.every(ANCHOR)
        if len(self.sums) <= PASSAGE:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = _sliding(g, _REACH + 1, np.minimum)
        # a run must not reach into the next row
        inside = self.row[: len(least)] == self.row[PASSAGE - 1 :][: len(least)]
        least = np.concatenate([np.zeros(_REACH, np.uint64), np.where(inside, least, 0), np.zeros(_REACH, np.uint64)])
        at = np.flatnonzero((g == _sliding(least, _REACH + 1, np.maximum)) & (g > 0))
        return at, g[at]


def _line_rows(x: Lines) -> tuple:
    """Each row's distinct lines: row, places (by line), leaf (null: nothing to generalise), line."""
    at = np.flatnonzero(x.line)
    at = at[np.lexsort((at, x.line[at], x.row[at]))]
    fresh = np.flatnonzero((np.diff(x.row[at], prepend=-1) != 0) | (np.diff(x.line[at].view(np.int64), prepend=0) != 0))
    one = at[fresh]
    return x.row[one], _listed(at - x.cut[x.row[at]], fresh), pa.array(x.leaf[one].view(np.int64), mask=x.leaf[one] == 0), x.line[one].view(np.int64)


def _anchor_rows(x: Runs) -> tuple:
    """Each row's anchors: row, places (by token), hash, hash of the tokens around."""
    at, anchor = x.anchors()
    row = x.row[at]
    low, high = np.maximum(x.first[row], at - _REACH), np.minimum(x.first[row + 1], at + PASSAGE)
    around = _text.mix(x.hashes(low, high) + ((at - low) << 8 | (high - at)).astype(np.uint64))
    # a text that repeats itself has the same surroundings at many places
    order = np.lexsort((at, around, row))
    at, row, anchor, around = at[order], row[order], anchor[order], around[order].view(np.int64)
    fresh = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(around, prepend=0) != 0))
    return row[fresh], _listed(at - x.first[row], fresh), anchor[fresh].view(np.int64), around[fresh]


@_text.trims
def _read(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of each kind, of words that are hashed once."""
    for batch in batches:
        ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
        for a, _, data, off in _text.blocks(batch.column("text")):
            words = _text.words(data, off, lower=False)
            for kind in kinds:
                row, places, group, hashed = _line_rows(Lines(data, off, words)) if kind == LINE else _anchor_rows(Runs(data, off, words))
                yield pa.record_batch({"doc_id": ids[a + row], "key": keys[a + row], "places": places, "a": group, "b": hashed, "kind": pa.array([kind]).take(pa.array(np.zeros(len(row), np.int32)))})


@_text.trims
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages around the wanted anchors of each row."""
    for batch in _slices(batches):
        ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
        for a, b, data, off in _text.blocks(batch.column("text")):
            x, found = Runs(data, off), []
            for i in range(b - a):
                n = int(x.first[i + 1] - x.first[i])
                places = batch.column("places")[a + i].values.to_numpy().astype(np.int64)
                at = np.unique((places[:, None] - np.arange(_REACH + 1)).ravel())
                at = at[(at >= 0) & (at + PASSAGE <= n)]
                found.append(at)
            row, place = np.repeat(np.arange(b - a), list(map(len, found))), np.concatenate(found)
            at = x.first[row] + place
            yield pa.record_batch({"doc_id": ids[a + row], "key": keys[a + row], "place": place.astype(np.int32), "run": x.hashes(at, at + PASSAGE).view(np.int64)})


def _without(text: bytes, begin: list[int], gone: np.ndarray, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray, token: np.ndarray) -> tuple[str, int]:
    """A text without lines that are gone and tokens that are covered, and how many lines went whole."""
    upto = np.concatenate([[0], np.cumsum(covered)])[token]
    hits = np.diff(upto)
    dead = gone | ((hits > 0) & (hits == np.diff(token)))
    # stretches of covered tokens of a line: a token goes with the white space after it, up to the line's last token
    opens, last = np.zeros(len(covered) + 1, bool), np.zeros(len(covered) + 1, bool)
    opens[token], last[token] = True, True
    before = covered.copy()
    before[1:] = covered[:-1]
    first = np.flatnonzero(covered & (opens[:-1] | ~before))
    after = np.append(covered[1:], False)
    final = np.flatnonzero(covered & (last[1:] | ~after))
    to = np.where(last[final + 1], ends[final], starts[np.minimum(final + 1, len(starts) - 1)]) if len(final) else final
    cut = np.searchsorted(first, token).tolist()
    frm, to = starts[first].tolist() if len(first) else [], to.tolist()
    out = []
    for k, (s, lost) in enumerate(zip(begin, dead.tolist(), strict=True)):
        if lost:
            continue
        e = begin[k + 1] - 1 if k + 1 < len(begin) else len(text)
        pieces = []
        for j in range(cut[k], cut[k + 1]):
            pieces.append(text[s : frm[j]])
            s = to[j]
        out.append((b"".join(pieces) + text[s:e]) if pieces else text[s:e])
    return b"\n".join(out).decode(), int(dead.sum())


@_text.trims
def _apply(batches: Iterator[pa.RecordBatch], leave: float) -> Iterator[pa.RecordBatch]:
    """Texts without what goes; _lines: places of lines; _spans: places of passages, or less than 0: of anchors, as -1 - place, that go with the tokens around."""
    for batch in _slices(batches):
        texts, total, dropped, cuts = [], [], [], []
        column = batch.column("text")
        for a, b, data, off in _text.blocks(column):
            x = Layout(data, off, *_text.bounds(data, off))
            for i in range(b - a):
                s, e = int(x.cut[i]), int(x.cut[i + 1])
                first, last = int(x.first[i]), int(x.first[i + 1])
                lines, spans = batch.column("_lines")[a + i], batch.column("_spans")[a + i]
                gone, covered, cut, lost, text = np.zeros(0, np.int64), None, 0, 0, column[a + i].as_py()
                if lines.is_valid:
                    gone = np.unique(lines.values.to_numpy())
                    if int(x.n[s + gone].sum()) > leave * (last - first):
                        gone = gone[:0]
                if spans.is_valid:
                    place = spans.values.to_numpy().astype(np.int64)
                    around = place < 0
                    place = np.where(around, -1 - place, place)
                    hit = np.bincount(np.maximum(0, place - _REACH * around), minlength=last - first + 1)
                    hit -= np.bincount(np.minimum(last - first, place + PASSAGE), minlength=last - first + 1)
                    covered = np.cumsum(hit)[:-1] > 0
                    cut = int(covered.sum())
                if text is not None and cut:
                    o = int(off[i])
                    token = np.append(x.token[s:e], last) - first
                    dead = np.zeros(e - s, bool)
                    dead[gone] = True
                    text, lost = _without(text.encode(), (x.begin[s:e] - o).tolist(), dead, x.starts[first:last] - o, x.ends[first:last] - o, covered, token)
                elif text is not None and len(gone):
                    dead, lost = set(gone.tolist()), len(gone)
                    text = "\n".join(t for k, t in enumerate(text.split("\n")) if k not in dead)
                texts.append(text)
                total.append(0 if text is None else e - s)
                dropped.append(lost)
                cuts.append(cut)
        names = [n for n in batch.schema.names if n not in ("text", "_lines", "_spans")]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, names), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (total, dropped, cuts))], names=[*names, "text", "n_lines", "n_dropped", "n_cut"]
        )


def _small(keys: DataFrame) -> DataFrame:
    """Keys of a written table, to be broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def _of_some(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``docs`` with what ``some(doc_id, key, ...)`` has for them; where these are few, only they are shuffled."""
    ids = some.select("doc_id").distinct()
    if ids.count() <= MAX_BROADCAST:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(some, ["doc_id", "key"])


def _line_drops(scratch: Scratch, docs: DataFrame, rows: DataFrame, min_docs: int) -> DataFrame:
    """``(doc_id, key, _lines)``: places of the lines that go."""
    rows = rows.withColumnsRenamed({"a": "leaf", "b": "line"})
    # a struct as the least would be sorted by; min_by is hashed
    low = (F.min("doc_id").alias("rep_id"), F.min_by("key", "doc_id").alias("rep_key"))
    by = rows.groupBy("line").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"), *low, F.max("doc_id").alias("high"))
    by = scratch.keep("by", by.where("n > 1 or leaf is not null"))
    # rows of one doc_id count once: of lines in three rows or more the documents are counted apart
    some = _small(by.where("n > 2").select("line"))
    docs_of = rows.join(some, "line").groupBy("line").agg(F.count_distinct("doc_id").alias("docs"))
    few = F.when(F.col("rep_id") == F.col("high"), 1).otherwise(2)
    by = by.join(docs_of, "line", "left").select("line", "leaf", "rep_id", "rep_key", F.coalesce("docs", few).cast("long").alias("docs"))
    by = scratch.keep("counted", by)
    exact = by.where(F.col("docs") >= min_docs).select("line", F.col("line").alias("template"), F.col("rep_id").alias("owner"))
    rest = by.where((F.col("docs") < min_docs) & F.col("leaf").isNotNull())
    open_ = rest.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    rest = scratch.keep("rest", rest.join(open_, "leaf"))
    # the tokens of each such line, from one document that has it
    wanted = scratch.keep("wanted", rest.groupBy(F.col("rep_id").alias("doc_id"), F.col("rep_key").alias("key")).agg(F.collect_list("line").alias("lines")))
    tokens = _of_some(docs, wanted).mapInArrow(_tokens, "leaf long, line long, tokens array<long>").dropDuplicates(["line"])
    tokens = scratch.keep("tokens", tokens.join(rest.select("line", "docs"), "line"))
    each = tokens.select("leaf", "line", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    literal = each.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "at", "token")
    variable = F.col("token") == F.lit(int(_VARIABLE.view(np.int64)))
    template = (
        each.join(literal, ["leaf", "at", "token"]).groupBy("leaf", "line", "n")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("of"), F.count(F.when(~variable, 1)).alias("literals"))
        .where((F.col("literals") >= LITERALS) & (F.col("literals") >= LITERAL_SHARE * F.col("n")))
        .select("line", F.xxhash64("leaf", "of").alias("template"))
    )
    template = scratch.keep("general", template)
    members = rows.select("doc_id", "line").join(_small(template), "line")
    general = members.groupBy("template").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("owner")).where(F.col("docs") >= min_docs)
    general = template.join(general.select("template", "owner"), "template").select("line", "template", "owner")
    known = scratch.keep("templates", exact.unionByName(general).select("line", "owner"))
    drops = rows.join(_small(known), "line").where("doc_id <> owner").groupBy("doc_id", "key").agg(F.flatten(F.collect_list("places")).alias("_lines"))
    drops = scratch.keep("drops", drops)
    scratch.drop("by", "counted", "rest", "wanted", "tokens", "general", "templates")
    return drops


def _passage_drops(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc_id, key, _spans)``: places of the passages and anchors that go."""
    rows = rows.withColumnsRenamed({"a": "anchor", "b": "around"})
    ends = (F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("around").alias("least"), F.max("around").alias("most"))
    shared = rows.groupBy("anchor").agg(*ends).where("low < high").select("anchor", F.expr("least < most").alias("several"))
    shared = scratch.keep("shared", shared)
    known = scratch.keep("known", rows.join(_small(shared), "anchor"))
    scratch.drop("shared")
    kinds = scratch.keep("kinds", known.groupBy("anchor", "around").agg(F.min("doc_id").alias("rep")))
    met = known.join(kinds, ["anchor", "around"]).select("doc_id", "key", "places", F.expr("doc_id <> rep").alias("alike"), "several").where("alike or several")
    met = scratch.keep("met", met)
    scratch.drop("known", "kinds")
    # tokens around an anchor that a smaller document has alike
    alike = met.where("alike").select("doc_id", "key", F.transform("places", lambda p: -1 - p).alias("spans"))
    open_ = scratch.keep("open", met.where("not alike").groupBy("doc_id", "key").agg(F.flatten(F.collect_list("places")).alias("places")))
    runs = scratch.keep("runs", _of_some(docs, open_).mapInArrow(_runs, "doc_id long, key long, place int, run long"), TEXTS)
    owned = runs.groupBy("run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high")).where("owner < high").select("run", "owner")
    partly = runs.join(owned, "run").where("doc_id <> owner")
    partly = partly.select("doc_id", "key", F.array("place").alias("spans"))
    drops = alike.unionByName(partly).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    drops = scratch.keep("spans", drops)
    scratch.drop("met", "open", "runs")
    return drops


def _rewritten(docs: DataFrame, lines: bool, passages: bool, min_docs: int, leave: float) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped", "n_cut", "_lines", "_spans", "_key")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    kinds = (LINE,) * lines + (ANCHORED,) * passages
    rows = scratch.keep("rows", texts.mapInArrow(lambda it: _read(it, kinds), "doc_id long, key long, places array<int>, a long, b long, kind string"), TEXTS, by="kind")
    of = {kind: rows.where(F.col("kind") == kind).drop("kind") for kind in kinds}
    found = []
    if lines:
        found.append(_line_drops(scratch, texts, of[LINE], min_docs).withColumn("_spans", F.lit(None).cast("array<int>")))
    if passages:
        found.append(_passage_drops(scratch, texts, of[ANCHORED]).withColumn("_lines", F.lit(None).cast("array<int>")))
    scratch.drop("rows")
    drops = found[0] if len(found) == 1 else scratch.keep(
        "all", found[0].unionByName(found[1]).groupBy("doc_id", "key").agg(F.first("_lines", ignorenulls=True).alias("_lines"), F.first("_spans", ignorenulls=True).alias("_spans"))
    )
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_lines", "_spans")
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    rest = None
    if (ids := drops.select("_id").distinct()).count() <= MAX_BROADCAST:
        # only texts that lose something are shuffled and go to Python
        ids = F.broadcast(ids)
        on = F.col("doc_id").cast("long") == F.col("_id")
        rest = docs.join(ids, on, "left_anti")
        docs = docs.join(ids, on, "left_semi")
    joined = docs.join(drops, same, "left").drop("_id", "_key")
    kept = [f for f in joined.schema if f.name not in ("text", "_lines", "_spans")]
    out = joined.mapInArrow(lambda it: _apply(it, leave), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, n_lines long, n_dropped long, n_cut long")
    if rest is None:
        return out
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    return out.unionByName(rest.select(*[F.col(f"`{f.name}`") for f in kept], "text", n_lines.alias("n_lines"), none.alias("n_dropped"), none.alias("n_cut")))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leave: float = 1.0) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` without the lines whose template recurs; n_lines, n_dropped and n_cut (0) are added.

    A text of which more than the share ``leave`` of tokens would go stays as it is:
    it is a copy rather than a text with recurring lines.  Lines end with a line
    feed.  A null text stays null; a row with a null doc_id is kept as it is and not
    counted; repeated rows of one doc_id count as one document and are treated
    alike; columns named n_lines, n_dropped, n_cut, _lines, _spans or _key are replaced.
    """
    return _rewritten(docs, True, False, min_docs, leave)


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` without the passages that a document of smaller id has too.

    n_lines, n_dropped (lines that went whole) and n_cut (tokens that went) are
    added.  Nulls, repeated rows and clashing columns are treated as in ``drop_recurring_lines``.
    """
    return _rewritten(docs, False, True, MIN_DOCS, 1.0)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` without recurring lines and repeated passages, both found in the texts as given.

    n_lines, n_dropped and n_cut are added, and the rest is treated as in ``drop_recurring_lines``.
    """
    return _rewritten(docs, True, True, min_docs, 1.0)
