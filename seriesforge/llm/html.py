"""Main text of web pages: markup rules, and boilerplate by a suffix array over each host's pages.

A page is tokenised into blocks of words.  Markup decides first: scripts, styles,
forms, menus, headers, footers, sidebars, notices, adverts and reader comments are
out, by element or by class, id or role; what stands inside ``article`` or
``main`` and is not out by that is in.  Blocks that markup leaves open (text of
pages without such an element, or beside it) are judged against the other pages of
the host: their token streams are concatenated, a suffix array is built, and
substrings of ``LEAST_TOKENS`` tokens or more, or whole blocks, that distinct pages
share are covered.  Tokens covered are boilerplate; unique runs stay, in page order
with what ``article`` and ``main`` elements hold.

Hosts are dealt into groups of at most about ``GROUP`` tokens by page content,
so a host of any size is split, and equal pages count as one.  For hosts that are split
the substrings of the least length are also counted by hash over the whole host, so the
result does not depend on the split.  Only pages with open blocks are grouped at all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text
from seriesforge.llm._spark import Scratch, ship_package

LEAST_TOKENS = 12
#: Open tokens of a host that are sorted in one group.
GROUP = 200_000

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?|[\"'])*+)>", re.S)
#: An attribute; quotes mean something after = only.
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_split = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_camel = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_space = re.compile(r"\s+")

# Element names by role in HTML.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video select title".split())
OUT = frozenset("nav footer aside form button menu dialog head label input option datalist fieldset".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words of class, id and role that name page furniture, and words that may stand beside them in a name.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside rail widget widgets complementary contentinfo "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion adsense "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox form "
    "share sharing social related recommended pagination pager toolbar skip "
    "comment comments commentlist respond replies reply disqus discussion".split()
)
BESIDE = frozenset(
    "main site page top bottom left right global primary secondary sub mobile desktop sticky fixed floating user reader wrapper wrap container outer inner area section "
    "block box bar panel list items item link links button buttons icons icon group region slot unit zone posts articles stories body row col column".split()
)


def _names_furniture(name: str) -> bool:
    """Whether a class, id or role is made of furniture words, numbers and words that may stand beside them: ``mainNav``, not ``post-header``."""
    parts = [p for p in _split.split(_camel.sub("-", name).lower()) if p and not p.isdigit()]
    return any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in BESIDE for p in parts)


def _furniture(attributes: str) -> bool:
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            if any(map(_names_furniture, value.split())):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(html: str) -> list[tuple[bool, str]]:
    """(whether an article or main element holds it, text) of the blocks of a page that markup does not rule out, in page order."""
    out: list[tuple[bool, str]] = []
    # of open elements: name, whether it is out, whether it is content
    stack: list[tuple[str, bool, bool]] = []
    state = [(False, False)]
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _space.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((state[-1][1], text))

    def close(to: int) -> None:
        flush()
        del stack[to:], state[to + 1 :]

    at, n = 0, len(html)
    for m in _tag.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not state[-1][0]:
            buffer.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0:
                # an inline or paragraph end does not close the structure around it
                if name in INLINE or name == "p":
                    if any(s[0] not in INLINE and s[0] != "p" for s in stack[depth + 1 :]):
                        continue
                if name in INLINE and all(s[0] in INLINE for s in stack[depth:]):
                    if stack[depth][1] and not state[depth][0]:
                        close(depth)
                    else:
                        del stack[depth:], state[depth + 1 :]
                else:
                    close(depth)
            elif name == "p" or name not in INLINE:
                flush()
            continue
        if name in INLINE and name not in OUT:
            out_now = state[-1][0] or _furniture(m[3])
            if out_now and not state[-1][0]:
                flush()
            if not m[3].endswith("/"):
                stack.append((name, out_now, state[-1][1]))
                state.append((out_now, state[-1][1]))
            continue
        if name in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE and stack[i][0] != "p"), -1)
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            if depth >= 0 and stack[depth][0] in same:
                close(depth)
        if name == "br":
            buffer.append(" ") if not state[-1][0] else None
            continue
        flush()
        if name in VOID or (m[3].endswith("/") and name not in RAW):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        inside = state[-1][1] or name in CONTENT
        # a header inside an article holds its title
        gone = state[-1][0] or name in OUT or (name == "header" and not state[-1][1]) or (name not in ("html", "body", "article", "main") and not (name == "header" and state[-1][1]) and _furniture(m[3]))
        stack.append((name, gone, inside))
        state.append((gone, inside))
    if at < n and not state[-1][0]:
        buffer.append(html[at:])
    flush()
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of a token sequence in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else rank[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = step
        if step[-1] == n - 1 or k >= n:
            return order
        k *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of neighbours in the suffix array, how many tokens agree, up to most."""
    n = len(s)
    lcp = np.zeros(max(0, n - 1), np.int64)
    live = np.arange(n - 1)
    for d in range(most):
        a, b = order[live] + d, order[live + 1] + d
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        same = s[a] == s[b]
        live = live[same]
        lcp[live] = d + 1
        if not len(live):
            break
    return lcp


def covered(pages: list[list[list[str]]]) -> list[list[np.ndarray]]:
    """For the blocks of distinct pages, which words stand in a substring that another page shares.

    A substring counts from LEAST_TOKENS words on, or where it is a whole block.
    """
    ids: dict[str, int] = {}
    stream, page_of = [0], [-1]
    places: list[list[int]] = []
    for p, page in enumerate(pages):
        places.append([])
        for words in page:
            places[-1].append(len(stream))
            stream += [ids.setdefault(w, len(ids) + 1) for w in words]
            # a mark of its own: no shared substring runs across blocks
            stream.append(-len(stream))
            page_of += [p] * (len(words) + 1)
    s, page = np.array(stream, np.int64), np.array(page_of)
    order = suffix_array(s)
    # a shared substring of the least length is a run of neighbours that agree so far and are of several pages
    hit = np.zeros(len(s) + 1, np.int64)
    lcp = common_prefixes(s, order, LEAST_TOKENS)
    _mark(hit, order, lcp >= LEAST_TOKENS, page, np.full(len(s), LEAST_TOKENS))
    # short blocks as wholes
    start = np.array([q - 1 for ps in places for q in ps], np.int64)
    size = np.array([len(w) for ps in pages for w in ps], np.int64)
    short = size < LEAST_TOKENS
    whole: dict[tuple, set[int]] = {}
    for q, k in zip(start[short].tolist(), size[short].tolist(), strict=True):
        whole.setdefault(tuple(stream[q + 1 : q + 1 + k]), set()).add(page_of[q + 1])
    for q, k in zip(start[short].tolist(), size[short].tolist(), strict=True):
        if len(whole[tuple(stream[q + 1 : q + 1 + k])]) > 1:
            hit[q + 1] += 1
            hit[q + 1 + k] -= 1
    inside = np.cumsum(hit)[:-1] > 0
    return [[inside[q : q + len(w)] for q, w in zip(ps, ws, strict=True)] for ps, ws in zip(places, pages, strict=True)]


def _mark(hit: np.ndarray, order: np.ndarray, agrees: np.ndarray, page: np.ndarray, length: np.ndarray) -> None:
    run = np.concatenate([[0], np.cumsum(~agrees)])
    low, high = np.full(run[-1] + 1, 1 << 60), np.full(run[-1] + 1, -1)
    np.minimum.at(low, run, page[order])
    np.maximum.at(high, run, page[order])
    shared = order[(low != high)[run] & (np.bincount(run)[run] > 1)]
    np.add.at(hit, shared, 1)
    np.add.at(hit, np.minimum(shared + length[shared], len(hit) - 1), -1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            b = batch.slice(first, 256)
            texts, opens, owns, sizes = [], [], [], []
            for h in b.column("html").to_pylist():
                found = blocks(h or "")
                left = [t for inside, t in found if not inside]
                sizes.append(sum(t.count(" ") + 1 for t in left))
                if left:
                    # what markup decides stands before, between and after the open blocks
                    around: list[list[str]] = [[]]
                    for inside, t in found:
                        around[-1].append(t) if inside else around.append([])
                    texts.append(None)
                    opens.append(left)
                    owns.append([" ".join(ts) for ts in around] if len(left) < len(found) else None)
                else:
                    texts.append(" ".join(t for _, t in found))
                    opens.append(None)
                    owns.append(None)
            names = [n for n in b.schema.names if n != "html"]
            more = [pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string())), pa.array(owns, pa.list_(pa.string())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *more], names=[*names, "text", "_open", "_own", "_size"])


def _keys(page: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a page: the length of its substrings that count, and a hash of the one at each place."""
    data, off = _text.utf8(pa.array(page, pa.string()))
    _, _, h, first = _text.words(data, off, lower=False)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = min(LEAST_TOKENS, e - s)
        yield n, _text.mix(_text.windows(h[s:e], n) + np.uint64(n))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(first, 256) for whole in batches for first in range(0, whole.num_rows, 256)):
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, page in enumerate(batch.column("open").to_pylist()):
            found.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for _, k in _keys(page))])))
            rows.append(np.full(len(found[-1]), i, np.int64))
        at = pa.array(np.concatenate(rows))
        yield pa.record_batch({"host": batch.column("host").take(at), "key": batch.column("key").take(at), "sub": np.concatenate(found).view(np.int64)})


def _judge(group: pa.Table) -> pa.Table:
    # one entry for each distinct page; pages of different articles may have the same open blocks
    opens = group.column("open").to_pylist()
    kept = []
    for page, shared, cover in zip(opens, group.column("shared"), covered([[t.split(" ") for t in page] for page in opens]), strict=True):
        if shared.is_valid:
            # substrings that pages of other parts share
            elsewhere = shared.values.to_numpy().view(np.uint64)
            for (n, keys), c in zip(_keys(page), cover, strict=True):
                for q in np.flatnonzero(np.isin(keys, elsewhere)).tolist():
                    c[q : q + n] = True
        kept.append([" ".join(w for w, c in zip(t.split(" "), cs.tolist(), strict=True) if not c) for t, cs in zip(page, cover, strict=True)])
    return pa.table({"key": group.column("key"), "kept": pa.array(kept, pa.list_(pa.string()))})


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """All rows of ``pages(url, html, ...)`` with ``text``, the main text, in place of html.

    Null and empty pages have an empty text, as have pages of boilerplate only.
    A null or odd url belongs to a host of its own.  Repeated and equal pages have one text, and do not make each other's text boilerplate;
    columns named text, _open, _own, _size, _key or _host are replaced.
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "html")
    pages = pages.drop("text", "_open", "_own", "_size", "_key", "_host")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    parsed = pages.mapInArrow(_parse, f"{kept}, text string, _open array<string>, _own array<string>, _size long")
    names = [c for c in pages.columns if c != "html"]
    parsed = scratch.keep("parsed", parsed)
    done = parsed.where("text is not null").select(*names, "text")
    left = parsed.where("text is null").select(*names, "_open", "_own", "_size")
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    left = left.withColumn("_host", host).withColumn("_key", F.xxhash64("_host", "_open", F.lit(0), "_own"))
    # one entry for each distinct page of a host; a number stands between the lists, so no block counts as of the other one
    entries = left.groupBy(F.col("_host").alias("host"), F.col("_key").alias("key")).agg(F.first("_open").alias("open"), F.first("_size").alias("size"))
    total = entries.groupBy("host").agg(F.ceil(F.sum("size") / group).cast("int").alias("groups"))
    entries = scratch.keep("entries", entries).join(scratch.keep("total", total), "host").withColumn("part", F.pmod("key", F.greatest("groups", F.lit(1))))
    subs = scratch.keep("subs", entries.where("groups > 1").select("host", "key", "open").mapInArrow(_substrings, "host string, key long, sub long"))
    shared = subs.groupBy("host", "sub").count().where("count > 1").select("host", "sub")
    shared = scratch.keep("shared", subs.join(shared, ["host", "sub"]).groupBy("host", "key").agg(F.collect_set("sub").alias("shared")))
    scratch.drop("subs")
    entries = entries.join(shared, ["host", "key"], "left")
    texts = entries.select("host", "part", "key", "open", "shared").groupBy("host", "part").applyInArrow(_judge, "key long, kept array<string>")
    texts = texts.select(F.col("key").alias("_key"), F.col("kept").alias("_kept"))
    mixed = F.flatten(F.zip_with("_own", F.concat("_kept", F.array(F.lit(""))), lambda own, kept: F.array(own, kept)))
    text = F.array_join(F.filter(F.coalesce(mixed, F.col("_kept")), lambda t: t != ""), " ")
    return done.unionByName(left.join(texts, "_key").select(*names, text.alias("text")))
