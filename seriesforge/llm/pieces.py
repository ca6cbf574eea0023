"""Sampled segmentation over a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has an edge for each place where a piece of the vocabulary
fits, and one of byte pieces for a character that is no piece.  Pieces have the
space mark at their start only and none holds a line feed, so the lattice falls
apart at both: words are independent, and one word's lattice serves all its
occurrences.  Forward sums run over each distinct word once; each occurrence is
then sampled backwards from its end, an incoming edge at a time, in proportion to
the edge's share of the forward sum.  The random numbers are hashes of the row's
key, the word's place and the step: they depend on nothing else, so a row is
segmented alike in any partitioning.  A word of more than ``LONG`` characters is first cut
where no piece reaches across; every path passes there, so its parts are words
of their own and neither time nor memory of a step follows the longest word.

Pieces weigh ``1 / (rank + 3) ** theta`` by their rank in the vocabulary (ids of
a merge-ranked model carry no probabilities).  Tokens are little-endian int32.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from seriesforge.llm import _text
from seriesforge.llm._spark import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words whose lattices a task keeps.
WORDS_HELD = 100_000
#: Characters of texts, words, and characters of new words, that are handled together.
CHUNK, FLAT, SLICE = 400_000, 100_000, 100_000
#: Words of more characters are cut first, where no piece stands across.
LONG = 32
#: Characters of a word from which it is summed up by itself, and steps from which it is walked by itself.
ALONE, WALK = 4096, 64
_cut = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_SLOTS = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as a trie of code points in a hash table, with log weights."""

    def __init__(self, model: str, theta: float):
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.size, self.theta = n, theta
        self.bytes_at = np.zeros(256, np.int64)
        self.text: list[bytes] = [b""] * n
        kids: list[dict[int, int]] = [{}]
        piece_of = [-1]
        rank = 0
        weight = np.full(n, -np.inf)
        #: characters of the longest piece
        self.longest = 1
        for i in range(n):
            if p.is_byte(i):
                b = int(p.id_to_piece(i)[3:5], 16)
                self.bytes_at[b] = i
                self.text[i] = bytes([b])
                continue
            if p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                continue
            rank += 1
            weight[i] = -theta * np.log(rank + 2)
            piece = p.id_to_piece(i).replace(MARK, " ")
            self.text[i] = piece.encode()
            self.longest = max(self.longest, len(piece))
            node = 0
            for c in map(ord, piece):
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    piece_of.append(-1)
                node = kids[node][c]
            piece_of[node] = i
        slots = _SLOTS
        while slots < 4 * len(kids):
            slots *= 2
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.keys, self.to = np.full(slots + 1, -1, np.int64), np.zeros(slots + 1, np.int32)
        for k, d in enumerate(kids):
            for c, to in d.items():
                at = int(self._slot(np.array([k << 21 | c]))[0])
                while self.keys[at] >= 0:
                    at = (at + 1) % slots
                self.keys[at], self.to[at] = k << 21 | c, to
        self.piece = np.array(piece_of, np.int32)
        self.width = np.array([len(t) for t in self.text], np.int64)
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.begin = np.cumsum(self.width) - self.width
        # pieces, then what stands for characters of one to four bytes that are none
        rare = -theta * np.log(n + 2) - 2
        self.weight = np.concatenate([weight, rare * np.arange(1, 5)])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def deepen(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state after a character; -1 where the trie ends."""
        key = state.astype(np.int64) << 21 | char
        at = self._slot(key)
        found = self.keys[at]
        to = np.where(found == key, self.to[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % (len(self.keys) - 1)
            found = self.keys[at[left]]
            same = found == key[left]
            to[left[same]] = self.to[at[left[same]]]
            left = left[~same & (found >= 0)]
        return to

    def matches(self, chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length less one: where pieces of it start, and which; left: how many characters may follow each place."""
        live, state, depth = np.arange(len(chars)), np.zeros(len(chars), np.int32), 0
        while len(live):
            state = self.deepen(state, chars[live + depth])
            on = state >= 0
            live, state = live[on], state[on]
            piece = self.piece[state]
            hit = piece >= 0
            yield depth, live[hit], piece[hit]
            depth += 1
            on = left[live] > depth
            live, state = live[on], state[on]

    def segments(self, word: str) -> list[str]:
        """A word cut where no piece stands across: its lattice falls apart there."""
        chars = _code_points(word)
        n = len(chars)
        crossed = np.zeros(n + 1, np.int32)
        for a in range(0, n, SLICE):
            part = chars[a : a + SLICE + self.longest]
            left = np.where(np.arange(len(part)) < SLICE, len(part) - np.arange(len(part)), 0)
            for depth, at, _ in self.matches(part, left):
                at = a + at[at < SLICE]
                if depth:
                    crossed += np.bincount(at + 1, minlength=n + 1).astype(np.int32)
                    crossed -= np.bincount(at + depth + 1, minlength=n + 1).astype(np.int32)
        at = [0, *(np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1).tolist(), n]
        return [word[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@functools.cache
def vocabulary(model: str, theta: float) -> Pieces:
    return Pieces(model, theta)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            larger = np.empty(self.n + self.n // 4 + 2 * len(more), self.all.dtype)
            larger[: self.n] = self.all[: self.n]
            self.all = larger
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)


class Lattices:
    """Lattices of distinct words, flattened: nodes are positions in words, each with its incoming edges in a row."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        #: of words: the last node; of nodes: the first incoming edge, -1 for a word's first node
        self.end, self.enter = _Grown(np.int64), _Grown(np.int64)
        #: of edges: the cumulated share in 32 bits less one, where it starts, its piece
        self.limit, self.start, self.piece = _Grown(np.uint32), _Grown(np.int32), _Grown(np.int32)

    def look_up(self, found: list[str]) -> np.ndarray:
        """The numbers of words, whose lattices are made where they are new."""
        ids = self.ids
        new = [w for w in dict.fromkeys(found) if w not in ids]
        if new:
            if len(ids) + len(new) > WORDS_HELD and ids:
                self.clear()
                ids, new = self.ids, list(dict.fromkeys(found))
            for i, w in enumerate(new, len(ids)):
                ids[w] = i
            first, chars = 0, 0
            for i, w in enumerate(new):
                chars += len(w)
                if chars >= SLICE:
                    self._build(new[first : i + 1])
                    first, chars = i + 1, 0
            if first < len(new):
                self._build(new[first:])
        return np.fromiter(map(ids.__getitem__, found), np.int64, len(found))

    def _build(self, new: list[str]) -> None:
        p, nodes, edges = self.pieces, self.enter.n, self.limit.n
        size = np.fromiter(map(len, new), np.int64, len(new))
        chars = _code_points("".join(new))
        n = len(chars)
        word = np.repeat(np.arange(len(new)), size)
        begin = np.cumsum(size) - size
        at = np.arange(n) - begin[word]
        # incoming[i, d]: the piece of d + 1 characters that ends with character i
        hits = list(p.matches(chars, size[word] - at))
        incoming = np.full((n, len(hits)), -1, np.int32)
        for depth, live, piece in hits:
            incoming[live + depth, depth] = piece
        lone = np.flatnonzero(incoming[:, 0] < 0)
        incoming[lone, 0] = p.size + chars[lone]
        row, back = np.nonzero(incoming >= 0)
        piece = incoming[row, back]
        lone = np.flatnonzero(piece >= p.size)
        kind = piece.copy()
        cp = piece[lone] - p.size
        kind[lone] = p.size + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        weight = p.weight[kind]
        # a word has one node more than characters
        node = np.arange(n) + word + 1
        start = node[row] - 1 - back
        count = np.bincount(row, minlength=n)
        enter = np.cumsum(count) - count
        if len(new) == 1 and n >= ALONE:
            share = _shares_alone(start.tolist(), weight.tolist(), count.tolist())
        else:
            share = self._shares(at, row, node, start, weight, count, n + len(new))
        run = np.cumsum(share)
        limit = np.minimum((run - (run[enter] - share[enter])[row]) * 2.0**32, 2.0**32 - 1)
        limit = np.maximum(limit, 0).astype(np.int64) - 1
        limit[enter + count - 1] = (1 << 32) - 1
        entered = np.full(n + len(new), -1, np.int64)
        entered[node] = enter + edges
        self.end.add(begin + size + np.arange(len(new)) + nodes)
        self.enter.add(entered)
        self.limit.add(np.maximum(limit, 0).astype(np.uint32))
        self.start.add((start + nodes).astype(np.int32))
        self.piece.add(piece)

    @staticmethod
    def _shares(at, row, node, start, weight, count, nodes) -> np.ndarray:
        """Each edge's share of its node's forward sum; sums run over all words together, a position at a time."""
        total, share = np.zeros(nodes), np.empty(len(row))
        small = np.uint16 if at.max() < 1 << 16 else np.int64
        by_row, by_edge = np.argsort(at.astype(small), kind="stable"), np.argsort(at[row].astype(small), kind="stable")
        each = np.bincount(at)
        last_row = np.cumsum(each)
        first = np.concatenate([[0], np.cumsum(count[by_row])])
        start, weight = start[by_edge], weight[by_edge]
        for a, b in zip((last_row - each).tolist(), last_row.tolist(), strict=True):
            rows, e0, e1 = by_row[a:b], first[a], first[b]
            opens = first[a:b] - e0
            x = total[start[e0:e1]] + weight[e0:e1]
            top = np.maximum.reduceat(x, opens)
            y = np.exp(x - np.repeat(top, count[rows]))
            z = np.add.reduceat(y, opens)
            total[node[rows]] = top + np.log(z)
            share[by_edge[e0:e1]] = y / np.repeat(z, count[rows])
        return share

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of word occurrences in order, and how many each has; one 64-bit seed for each occurrence."""
        n = len(word)
        limit, start, enter, pieces = self.limit.all, self.start.all, self.enter.all, self.piece.all
        node, count, live = self.end.all[word], np.zeros(n, np.int64), np.arange(n)
        steps, walked = [], []
        while len(live):
            step = len(steps)
            if step == WALK:
                for i, at in zip(live.tolist(), node.tolist(), strict=True):
                    walked.append((i, self._walk(at, int(seed[i]), step)))
                    count[i] += len(walked[-1][1])
                break
            u = (_text.mix(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.uint32)
            # the first incoming edge whose limit is not below u
            e = enter[node]
            late = np.flatnonzero(limit[e] < u)
            while len(late):
                e[late] += 1
                late = late[limit[e[late]] < u[late]]
            steps.append((live, pieces[e]))
            count[live] += 1
            node = start[e]
            more = enter[node] >= 0
            live, node = live[more], node[more]
        offset = np.cumsum(count)
        out = np.empty(int(offset[-1]) if n else 0, np.int64)
        for j, (i, piece) in enumerate(steps):
            out[offset[i] - 1 - j] = piece
        for i, piece in walked:
            out[offset[i] - WALK - len(piece) : offset[i] - WALK] = piece[::-1]
        return out, count

    def _walk(self, node: int, seed: int, step: int) -> np.ndarray:
        """The rest of one long word, from its end."""
        limit, start, enter, pieces, out = self.limit.all, self.start.all, self.enter.all, self.piece.all, []
        while (e := int(enter[node])) >= 0:
            h = (seed + step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = ((h ^ h >> 33) * k) & 0xFFFFFFFFFFFFFFFF
            u = (h ^ h >> 33) >> 32
            while limit[e] < u:
                e += 1
            out.append(pieces[e])
            node, step = int(start[e]), step + 1
        return np.array(out, np.int64)


def _shares_alone(start: list[int], weight: list[float], count: list[int]) -> np.ndarray:
    """Shares of the edges of one word, node by node."""
    total, share, e = [0.0], [], 0
    for c in count:
        x = [total[start[k]] + weight[k] for k in range(e, e + c)]
        top = max(x)
        y = [math.exp(v - top) for v in x]
        z = sum(y)
        total.append(top + math.log(z))
        share += [v / z for v in y]
        e += c
    return np.array(share)


def _spelled(pieces: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary become the pieces of their bytes."""
    virtual = np.flatnonzero(ids >= pieces.size)
    if not len(virtual):
        return ids, count
    cps = ids[virtual] - pieces.size
    coded = [chr(c).encode("utf-8", "surrogatepass") for c in cps.tolist()]
    width = np.ones(len(ids), np.int64)
    width[virtual] = [len(c) for c in coded]
    out = np.repeat(ids, width)
    at = np.cumsum(width) - width
    flat = pieces.bytes_at[np.frombuffer(b"".join(coded), np.uint8)]
    w = width[virtual]
    out[np.repeat(at[virtual] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))] = flat
    owner = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(owner, width, len(count)).astype(np.int64)


def row_seed(seed: int, key) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def _words(pieces: Pieces, text: str | None) -> list[str]:
    """The words of a text, long ones in segments."""
    found = _cut.findall(" " + text) if text else []
    if found and max(map(len, found)) > LONG:
        found = [s for w in found for s in (pieces.segments(w) if len(w) > LONG else (w,))]
    return found


def encode_texts(lattices: Lattices, keys: list, texts: list[str | None], seed: int) -> list[bytes | None]:
    """Sampled tokens of each text; None of None."""
    out: list[bytes | None] = []
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last] or "") <= CHUNK):
            chars += len(texts[last] or "")
            last += 1
        found = [_words(lattices.pieces, t) for t in texts[first:last]]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = [w for f in found for w in f] if len(found) > 1 else found[0]
        seeds = np.array([row_seed(seed, k) for k in keys[first:last]], np.uint64)
        place = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        each = _text.mix(np.repeat(seeds, sizes) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        parts = [_spelled(lattices.pieces, *lattices.sample(lattices.look_up(flat[a : a + FLAT]), each[a : a + FLAT])) for a in range(0, len(flat), FLAT)]
        ids = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        cut = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        ids = ids.astype("<i4")
        out += [ids[a:b].tobytes() if t is not None else None for a, b, t in zip(cut[:-1], cut[1:], texts[first:last], strict=True)]
        first = last
    return out


def decode_tokens(pieces: Pieces, tokens: bytes | None) -> str | None:
    if tokens is None:
        return None
    ids = np.frombuffer(tokens, "<i4")
    width = pieces.width[ids]
    at = np.repeat(pieces.begin[ids] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    return pieces.flat[at].tobytes()[1:].decode("utf-8", "surrogatepass")


@_text.trims
def _encode(batches: Iterator[pa.RecordBatch], key: str, model: str, theta: float, seed: int) -> Iterator[pa.RecordBatch]:
    lattices = Lattices(vocabulary(model, theta))
    for batch in batches:
        for first in range(0, batch.num_rows, 250):
            b = batch.slice(first, 250)
            tokens = encode_texts(lattices, b.column(key).to_pylist(), b.column("text").to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.binary())], names=[*b.schema.names, "tokens"])
        _text.trim()


@_text.trims
def _round_trip(batches: Iterator[pa.RecordBatch], key: str, model: str, theta: float, seed: int) -> Iterator[pa.RecordBatch]:
    """As ``_encode``, the text replaced by whether decoding gives it back."""
    pieces = vocabulary(model, theta)
    for b in _encode(batches, key, model, theta, seed):
        pairs = zip(b.column("text").to_pylist(), b.column("tokens").to_pylist(), strict=True)
        same = pa.array([t == decode_tokens(pieces, k) for t, k in pairs], pa.bool_())
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, names), same], names=[*names, "lossless"])


@_text.trims
def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = vocabulary(model, 1.0)
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            b = batch.slice(first, 500)
            texts = [decode_tokens(pieces, t) for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` (one named text, one named key) and ``tokens``, a sampled segmentation of the whole text.

    A larger theta sharpens the choice towards frequent pieces.  A null text has
    null tokens, an empty one none; a null key is a key like others, and rows of
    one key and text have one segmentation; a column named tokens is replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("tokens")
    return docs.mapInArrow(lambda it: _encode(it, key, model, theta, seed), f"{_schema(docs)}, tokens binary")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` (one named tokens) and ``decoded``, the text that was encoded; null of null."""
    ship_package(rows.sparkSession)
    rows = rows.drop("decoded")
    return rows.mapInArrow(lambda it: _decode(it, model), f"{_schema(rows)}, decoded string")


def round_trip(docs: DataFrame, key: str = "doc_id", model: str = MODEL, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` but the text, its ``tokens`` as of ``encode``, and ``lossless``: whether ``decode`` gives the text back.

    Both are done by one Python worker of a task, and no text goes back to the JVM.
    A null text comes back as null; columns named tokens or lossless are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("tokens", "lossless")
    return docs.mapInArrow(lambda it: _round_trip(it, key, model, theta, seed), f"{_schema(docs.drop('text'))}, tokens binary, lossless boolean")
