"""Exact Jaccard self-join of documents on word shingles by token-combination prefixes.

1. Each text becomes its set of distinct w-word shingles (64-bit hashes).  Texts
   with one set form a node; copies are never expanded.
2. A set of which more than a quarter stands in no other set has no link.  This is
   tested first on the tokens whose hash is below a bound (``RATE`` of all; all
   tokens of sets below ``WHOLE``): a linked set may miss as many tokens there as
   anywhere.  The tokens go by blocks of many sets to the part that counts them,
   which sends back how many tokens of each set are shared.
3. For the sets that are left the number of sets that hold each token is counted
   exactly.  Tokens of a set are ordered by it, rare ones first, and the prefix is the
   shortest for which two linked sets must share a signature: a token that up to
   ``RARE`` sets hold is one by itself; frequent tokens fall into subclasses, of
   which pairs are signatures, so the prefix is extended by one token for each
   subclass.  Sizes within the threshold share a subclassing.
4. Nodes that share a signature are candidates.  A signature of up to ``SMALL``
   nodes gives its pairs.  In a larger one the nodes are compared with
   ``PIVOTS`` pivots; nodes that then are in one component need no more
   comparing.  Those outside the signature's largest component meet other pivots
   of it in ``ROUNDS`` rounds.  What then is still outside is compared with all
   other components of its group (nodes that large signatures connect), block by
   block, without making pairs.
5. Pairs pass a bitmap bound (each differing bit is a differing shingle), then
   whole sets are intersected.

Node ids are 64-bit hashes of sets: n distinct texts meet by chance with
probability n**2 / 2**65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import _text
from seriesforge.llm._spark import Scratch, ship_package
from seriesforge.llm.components import connected_components

#: Share of a set's tokens, by hash, that the first test looks at, and the size below which it looks at all.
RATE, WHOLE = 0.35, 64
#: Sets that hold a token up to which it is a signature by itself.
RARE = 16
#: Tokens of a block of sets in the first and in the second count.
BLOCK_TOKENS, SET_TOKENS = 1_500_000, 300_000
#: Characters of texts for one part of the first count, and tokens for one of the second.
PART_CHARS, PART_TOKENS = 16_000_000, 1_000_000
#: Texts, and pairs of whole sets, that go to Python at once.
TEXTS, PAIRS = 1000, 200
#: Document and node ids (8 bytes each) up to which they are broadcast.
MAX_BROADCAST = 1 << 20
#: Nodes of a signature up to which its pairs are taken directly.
SMALL = 12
#: Pivots of a larger signature.
PIVOTS = 5
#: Times that nodes outside a signature's largest component meet pivots of it.
ROUNDS = 1
#: Nodes on either side that are compared in one task.
BLOCK = 512
_NO_SET = 0xFFFF


def node_of(s: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), np.int64)[0])


def _allowed(n: int, percent: int) -> int:
    """How many tokens of a set of n may be missing from a linked set."""
    return n - -(-percent * n // 100)


def signatures(s: np.ndarray, held: np.ndarray, percent: int = 75, rare: int = RARE) -> np.ndarray:
    """Signatures of a set, of whose tokens so many sets hold each: two linked sets share one at least."""
    n = len(s)
    order = np.lexsort((s, held))
    # tokens of no other set come first and are no signatures
    alone = int((held == 1).sum())
    need = _allowed(n, percent) + 1 - alone
    if need <= 0:
        return s[:0]
    s, held = s[order][alone:], held[order][alone:]
    few = int(np.searchsorted(held, rare, "right"))
    if few >= need:
        return s[:need]
    often, need, out = s[few:], need - few, [s[:few]]
    # sets whose sizes are in the ratio `percent` are in one size class or in adjacent ones
    base = 100 / percent
    level = int(math.log(n) / math.log(base))
    for scheme in (level, level - 1):
        least = base**scheme
        if least < 32:
            out.append(often[:need])
            continue
        m = np.uint64(math.ceil(least / 16))
        sub = (often >> np.uint64(20)) % m
        gain = np.ones(len(often), np.int64)
        gain[np.unique(sub, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(gain), need)) + 1
        token, sub = often[:end], sub[:end]
        by = np.argsort(sub, kind="stable")
        token, sub = token[by], sub[by]
        tag = np.uint64((scheme + 1) * 0xD6E8FEB86659FD93 % 2**64)
        for gap in range(1, end):
            same = sub[gap:] == sub[:-gap]
            if not same.any():
                break
            x, y = token[:-gap][same], token[gap:][same]
            out.append(_text.mix(x * np.uint64(0xA24BAED4963EE407) + y * np.uint64(0x9FB21C651E98DF25) + tag))
    return np.unique(np.concatenate(out))


def _limit(n: float) -> int:
    """Hashes up to this one are looked at in sets of n tokens or more."""
    return int(RATE * 2**64) if n >= WHOLE else 2**64 - 1


def _parts(tokens: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of tokens by the part that counts them."""
    part = ((tokens >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        yield p, order[edge[p] : edge[p + 1]]


_MARK_SCHEMA = "kind int, doc_id long, node long, n int, block long, idx int, spare int, part int, tokens binary, owner binary"
_MARKS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("block", pa.int64()), ("idx", pa.int32()), ("spare", pa.int32()), ("part", pa.int32()), ("tokens", pa.binary()), ("owner", pa.binary())])


@_text.trims
def _marks(batches: Iterator[pa.RecordBatch], w: int, percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document with its node; at a node's first place in a task also its number in its block, and how many
    tokens that other blocks hold it lacks for a link.  Kind 1: tokens of a block for one part, and the set of each, if one only.
    """
    task, blocks, seen = TaskContext.get().partitionId(), 0, set()
    docs: list[tuple] = []
    tokens: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    spares: list[int] = []
    held = 0

    def rows(of: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*of, strict=True), _MARKS.types, strict=True)], schema=_MARKS)

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal docs, tokens, owners, spares, held, blocks
        if not docs:
            return
        block = task << 32 | blocks
        own = np.zeros(len(spares), np.int64)
        if tokens:
            t, o = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            twice = t[1:] == t[:-1]
            shared = np.concatenate([[False], twice]) | np.concatenate([twice, [False]])
            own = np.bincount(o[shared & (o != _NO_SET)], minlength=len(spares))
            o[shared] = _NO_SET
            first = np.concatenate([[True], ~twice])
            t, o = t[first], o[first]
            for p, at in _parts(t, parts):
                yield rows([(1, None, None, None, block, None, None, p, t[at].tobytes(), o[at].tobytes())])
        yield rows([(0, d, node, n, block if i is not None else None, i, None if i is None else spares[i] - int(own[i]), None, None, None) for d, node, n, i in docs])
        docs, tokens, owners, spares, held, blocks = [], [], [], [], 0, blocks + 1

    for batch in batches:
        for d, s in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), _text.shingle_sets(batch.column("text"), w), strict=True):
            node, n, at = node_of(s), len(s), None
            if n and d is not None and node not in seen:
                seen.add(node)
                at = len(spares)
                sent = s[: np.searchsorted(s, np.uint64(_limit(n * percent / 100)), "right")]
                tested = int(np.searchsorted(sent, np.uint64(_limit(n)), "right"))
                tokens.append(sent)
                owner = np.full(len(sent), _NO_SET, np.uint16)
                owner[:tested] = at
                owners.append(owner)
                spares.append(tested - _allowed(n, percent))
                held += len(sent)
            docs.append((d, node, n, at))
            if held >= BLOCK_TOKENS or len(spares) >= _NO_SET - 1 or len(docs) >= 1 << 17:
                yield from settled()
    yield from settled()


def _shared(group: pa.Table) -> pa.Table:
    """Of one part's tokens: those of each block that other blocks hold too, as the sets that hold them."""
    blocks = group.column("block").to_numpy()
    tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens")]
    owner = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in group.column("owner")])
    t = np.concatenate(tokens)
    order = np.argsort(t, kind="stable")
    twice = np.diff(t[order]) == 0
    several = np.zeros(len(t), bool)
    several[order] = np.concatenate([[False], twice]) | np.concatenate([twice, [False]])
    several &= owner != _NO_SET
    edge = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
    found = [owner[a:b][several[a:b]].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"block": blocks, "owner": pa.array(found, pa.binary())})


def _summed(group: pa.Table) -> pa.Table:
    """How many tokens each set of one block shares."""
    n = np.zeros(0, np.int64)
    for x in group.column("owner"):
        more = np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=len(n))
        more[: len(n)] += n
        n = more
    idx = np.flatnonzero(n)
    return pa.table({"block": np.full(len(idx), group.column("block")[0].as_py()), "idx": idx.astype(np.int32), "shared": n[idx]})


def bitmap(s: np.ndarray, width: int = 8) -> bytes:
    """A bitmap of a set, of width times as many bits as it has tokens or more, a power of two."""
    bits = max(64, 1 << (width * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def bitmap_differs(x: bytes, y: bytes) -> int:
    """A lower bound of how many tokens are in one of two sets only."""
    if len(x) > len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)))
    return int(np.bitwise_count(a ^ b).sum())


_SET_SCHEMA = "kind int, block long, node long, n int, bits binary, part int, tokens binary, counts binary"
_SETS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])


@_text.trims
def _sets(batches: Iterator[pa.RecordBatch], w: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a wanted node's set, by blocks; kind 1: distinct tokens of a block for one part, and how many of its sets hold each."""
    task, blocks, seen = TaskContext.get().partitionId(), 0, set()
    found: list[tuple] = []
    held: list[np.ndarray] = []
    size = 0

    def rows(of: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*of, strict=True), _SETS.types, strict=True)], schema=_SETS)

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal found, held, size, blocks
        if found:
            block = task << 32 | blocks
            t, n = np.unique(np.concatenate(held), return_counts=True)
            yield rows([(0, block, node, k, bits, None, s, None) for node, k, bits, s in found])
            for p, at in _parts(t, parts):
                yield rows([(1, block, None, None, None, p, t[at].tobytes(), n[at].astype(np.uint32).tobytes())])
            found, held, size, blocks = [], [], 0, blocks + 1

    for batch in batches:
        for want, s in zip(batch.column("node").to_pylist(), _text.shingle_sets(batch.column("text"), w), strict=True):
            if want in seen or node_of(s) != want:
                continue
            seen.add(want)
            found.append((want, len(s), bitmap(s), s.tobytes()))
            held.append(s)
            size += len(s)
            if size >= SET_TOKENS:
                yield from settled()
    yield from settled()


def _counted(group: pa.Table) -> pa.Table:
    """Of one part's tokens: those that several sets hold, by block, and how many."""
    blocks = group.column("block").to_pylist()
    tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens")]
    t = np.concatenate(tokens)
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")])
    _, at = np.unique(t, return_inverse=True)
    total = np.bincount(at, n).astype(np.uint32)[at]
    out_t, out_n, first = [], [], 0
    for x in tokens:
        each = total[first : first + len(x)]
        several = each > 1
        out_t.append(x[several].tobytes())
        out_n.append(each[several].tobytes())
        first += len(x)
    return pa.table({"block": pa.array(blocks, pa.int64()), "tokens": pa.array(out_t, pa.binary()), "counts": pa.array(out_n, pa.binary())})


def _signed(sets: pa.Table, counts: pa.Table, percent: int) -> pa.Table:
    """Signatures of the sets of one block."""
    none = np.zeros(0, np.uint64)
    t = np.concatenate([none, *(np.frombuffer(x.as_buffer(), np.uint64) for x in counts.column("tokens"))])
    n = np.concatenate([none.astype(np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in counts.column("counts"))])
    order = np.argsort(t)
    t, n = np.append(t[order], np.uint64(2**64 - 1)), np.append(n[order], 1).astype(np.int64)
    sigs, nodes, sizes = [none], [none.astype(np.int64)], [none.astype(np.int32)]
    for node, x in zip(sets.column("node").to_pylist(), sets.column("tokens"), strict=True):
        s = np.frombuffer(x.as_buffer(), np.uint64)
        at = np.searchsorted(t, s)
        sig = signatures(s, np.where(t[at] == s, n[at], 1), percent)
        sigs.append(sig)
        nodes.append(np.full(len(sig), node, np.int64))
        sizes.append(np.full(len(sig), len(s), np.int32))
    return pa.table({"sig": np.concatenate(sigs).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(sizes)})


@_text.trims
def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that the bitmap bound does not rule out."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        keep = np.ones(len(na), bool)
        for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
            # |x ^ y| = |x| + |y| - 2 |x & y| and |x & y| >= percent (|x| + |y|) / (100 + percent) for linked sets
            keep[i] = bitmap_differs(x, y) * (100 + percent) <= (int(na[i]) + int(nb[i])) * (100 - percent)
        yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))


@_text.trims
def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("ta"), batch.column("tb")
        both = [
            len(np.intersect1d(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64), assume_unique=True))
            for i in range(batch.num_rows)
        ]
        yield pa.record_batch(
            {"a": batch.column("a"), "b": batch.column("b"), "na": batch.column("na"), "nb": batch.column("nb"), "common": pa.array(both, pa.int64())}
        )


def linked_nodes(spark: SparkSession, scratch: Scratch, docs: DataFrame, w: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents with nodes and set sizes, and ``(node, root)`` of the nodes that have links."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # several parts for each task of a shuffle: they are dealt by hash
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(chars / PART_CHARS))
    marks = scratch.keep("marks", docs.mapInArrow(lambda it: _marks(it, w, percent, parts), _MARK_SCHEMA), TEXTS, by="kind")
    nodes = marks.where("kind = 0").select("doc_id", "node", "n")
    shared = marks.where("kind = 1").select("part", "block", "tokens", "owner").groupBy("part").applyInArrow(_shared, "block long, owner binary")
    shared = shared.groupBy("block").applyInArrow(_summed, "block long, idx int, shared long")
    first = marks.where("kind = 0 and idx is not null").select("doc_id", "node", "n", "block", "idx", "spare")
    left = first.join(shared, ["block", "idx"], "left").where("spare <= coalesce(shared, 0)")
    wanted = scratch.keep("wanted", left.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    scratch.drop("marks/kind=1")

    size = wanted.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    parts = max(least, math.ceil((size["tokens"] or 0) / PART_TOKENS))
    some = wanted.select("doc_id", "node")
    texts = docs.join(F.broadcast(some) if size["rows"] <= MAX_BROADCAST else some, "doc_id")
    kept = scratch.keep("sets", texts.mapInArrow(lambda it: _sets(it, w, parts), _SET_SCHEMA), TEXTS, by="kind")
    sets = kept.where("kind = 0").select("block", "node", "n", "bits", "tokens")
    if sets.count() > size["rows"]:  # rows that several tasks have
        sets = scratch.keep("once", sets.dropDuplicates(["node"]))
    counts = kept.where("kind = 1").select("part", "block", "tokens", "counts").groupBy("part").applyInArrow(_counted, "block long, tokens binary, counts binary")
    signed = sets.select("block", "node", "tokens").groupBy("block").cogroup(counts.groupBy("block"))
    signed = scratch.keep("signed", signed.applyInArrow(lambda x, y: _signed(x, y, percent), "sig long, node long, n int").distinct())
    scratch.drop("sets/kind=1")
    several = signed.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    held = scratch.keep("held", signed.join(several, "sig").withColumn("large", F.col("c") > SMALL).drop("c"))
    scratch.drop("signed", "wanted")

    def verified(name: str, pairs: DataFrame, bounded: bool = False) -> DataFrame:
        """Links among pairs ``(a < b, na, nb)``: sizes, then bitmaps (unless bounded by them already), then whole sets are compared."""
        pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
        near = pairs if bounded else (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("bits").alias("xa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("bits").alias("xb")), "b")
            .mapInArrow(lambda it: _bounded(it, percent), "a long, b long, na int, nb int")
        )
        near = scratch.keep(f"near-{name}", near)
        # whole sets are moved for the nodes of these pairs only
        ids = scratch.keep(f"ids-{name}", near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        some = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
        whole = sets.select("node", "tokens").join(some, "node", "left_semi")
        out = scratch.keep(
            f"links-{name}",
            near.join(whole.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(whole.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
            .mapInArrow(_intersected, "a long, b long, na int, nb int, common long")
            .where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
            .select(F.col("a").alias("u"), F.col("b").alias("v")),
            PAIRS,
        )
        scratch.drop(f"near-{name}", f"ids-{name}")
        return out

    few, many = held.where("not large").drop("large"), held.where("large").drop("large")
    pivots = _pivots(many, 0)
    links = verified("first", _paired(few, few, ordered=True).unionByName(_paired(pivots, many)))
    roots = connected_components(Scratch(spark, "jaccard-cc"), links)

    for i in range(ROUNDS + 1):
        rooted = scratch.keep(f"rooted{i}", many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        part = rooted.groupBy("sig", "root").agg(F.count("*").alias("c"))
        main = part.groupBy("sig").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
        main = scratch.keep(f"main{i}", main.where("roots > 1").select("sig", "main"))
        if main.isEmpty():
            return nodes, roots
        if i == ROUNDS:
            break
        # those outside the largest component meet some of its members, other ones in each round
        both = scratch.keep(f"parted{i}", rooted.join(main, "sig"))
        chosen = _pivots(both.where("root = main"), PIVOTS * (i + 1))
        met = verified(f"round{i}", _paired(chosen, both.where("root <> main").select("sig", "node", "n")))
        scratch.drop(f"rooted{i}", f"main{i}", f"parted{i}")
        roots = connected_components(Scratch(spark, "jaccard-cc"), roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(met))
    # nodes that a large signature of several components connects form a group: what shares one is in one
    open_ = rooted.join(main.select("sig"), "sig")
    star = open_.join(open_.groupBy("sig").agg(F.min("node").alias("low")), "sig").select(F.col("node").alias("u"), F.col("low").alias("v"))
    group = connected_components(Scratch(spark, "jaccard-cc"), star).select("node", F.col("root").alias("group"))
    each = open_.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    each = scratch.keep("each", each.join(group, "node"))
    per = each.groupBy("group", "root").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("largest"))
    per = scratch.keep("groups", per.where("size > largest").select("group", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("largest")) / BLOCK).cast("int").alias("parts")))
    still = scratch.keep("still", each.join(per, "group").join(sets.select("node", "bits"), "node"))
    blocks, parts = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "parts"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    columns = ["group", "part", "block", "node", "n", "root", "bits"]
    rest = still.where("root <> main").withColumn("part", own("parts")).withColumn("block", blocks).select(columns)
    every = still.withColumn("block", own("blocks")).withColumn("part", parts).select(columns)
    keys = ["group", "part", "block"]
    near = rest.groupBy(keys).cogroup(every.groupBy(keys)).applyInArrow(lambda x, y: _compared(x, y, percent), "a long, b long, na int, nb int")
    more = verified("rest", near, bounded=True)
    merged = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
    return nodes, connected_components(Scratch(spark, "jaccard-cc"), merged)


def _pivots(rows: DataFrame, seed: int) -> DataFrame:
    """Up to PIVOTS nodes of each signature, by hashes: mostly the same ones where signatures have the same nodes."""
    x = F.array_distinct(F.array(*[F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(seed + i))) for i in range(PIVOTS)]))
    return rows.groupBy("sig").agg(x.alias("x")).select("sig", F.explode("x").alias("x")).select("sig", "x.node", "x.n")


def _paired(x: DataFrame, y: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows of x and y that share a signature, as pairs a < b."""
    both = x.select("sig", F.col("node").alias("p"), F.col("n").alias("np")).join(y, "sig").where("p < node" if ordered else "p <> node")
    first = F.col("p") < F.col("node")
    return both.select(
        F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"),
        F.when(first, F.col("np")).otherwise(F.col("n")).alias("na"), F.when(first, F.col("n")).otherwise(F.col("np")).alias("nb"),
    )


def _compared(x: pa.Table, y: pa.Table, percent: int) -> pa.Table:
    """Of x against y, blocks of one group's nodes: the pairs of different roots that sizes and bitmaps allow."""

    def columns(t):
        return *(t.column(c).to_numpy() for c in ("node", "n", "root")), [np.frombuffer(b, np.uint64) for b in t.column("bits").to_pylist()]

    xn, xs, xr, xb = columns(x)
    yn, ys, yr, yb = columns(y)
    found = []
    widths = [np.array([len(b) for b in bits]) for bits in (xb, yb)]
    for wx in np.unique(widths[0]):
        for wy in np.unique(widths[1]):
            i, j = np.flatnonzero(widths[0] == wx), np.flatnonzero(widths[1] == wy)
            w = min(wx, wy)
            p = np.bitwise_or.reduce(np.stack([xb[k] for k in i]).reshape(len(i), -1, w), 1)
            q = np.bitwise_or.reduce(np.stack([yb[k] for k in j]).reshape(len(j), -1, w), 1)
            for first in range(0, len(i), 64):
                k = i[first : first + 64]
                small, large = np.minimum(xs[k, None], ys[None, j]), np.maximum(xs[k, None], ys[None, j])
                ok = (xr[k, None] != yr[None, j]) & (small.astype(np.int64) * 100 >= large.astype(np.int64) * percent)
                u, v = np.nonzero(ok)
                for at in range(0, len(u), 50_000):
                    a, b = u[at : at + 50_000], v[at : at + 50_000]
                    differs = np.bitwise_count(p[first + a] ^ q[b]).sum(1, dtype=np.int64)
                    keep = differs * (100 + percent) <= (xs[k[a]].astype(np.int64) + ys[j[b]]) * (100 - percent)
                    found.append(np.stack([k[a[keep]], j[b[keep]]]))
    i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    swap = xn[i] > yn[j]
    return pa.table({
        "a": np.where(swap, yn[j], xn[i]), "b": np.where(swap, xn[i], yn[j]),
        "na": np.where(swap, ys[j], xs[i]).astype(np.int32), "nb": np.where(swap, xs[i], ys[j]).astype(np.int32),
    })


def jaccard_classes(docs: DataFrame, w: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links of ``percent`` or more reach.
    A null or blank text has no shingles and is linked with nothing; a null
    doc_id is returned with the component of its text, or null.  Repeated rows
    are returned as often as given; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    nodes, roots = linked_nodes(spark, scratch, docs, w, percent)
    rep = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    rooted = scratch.keep("rep", rep.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    low = scratch.keep("low", rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = scratch.keep("named", rooted.join(low, "root").select("node", "component_id"))
    scratch.drop("held", "sets", "once", f"rooted{ROUNDS}", "still", "each", "groups", f"main{ROUNDS}", "rep", "low")
    return nodes.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
