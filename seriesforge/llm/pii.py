"""Personal data: fixed base patterns, and a character BiLSTM with CRF transitions that adds spans.

The model is trained here, in numpy, from labelled spans that a seeded
generator writes.  Every span of the four kinds holds a digit, an ``@`` or a
spelled-out at sign, so windows are laid over ``MARGIN`` characters on either side of such anchors;
a span is not looked for farther away.  Emissions of overlapping windows are
averaged and each region is decoded once, by Viterbi, so windows never disagree.
An added span must keep clear of the base spans and have the digits of its kind.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seriesforge.llm._spark import ship_package

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 96, 48, 64
#: Mean posterior that an added span needs.
LEAST_POSTERIOR = 0.7
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 24
ANCHOR = r"[0-9@]|[\[(] ?at ?[\])]"

_anchor = re.compile(ANCHOR)
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start.

    Email matches are found from their ``@`` and the digit patterns start at
    runs of digits, which gives the leftmost matches in linear time.
    """
    out, end = [], 0
    for m in _domain.finditer(text):
        at = s = m.start()
        while s > end and text[s - 1] in _local:
            s -= 1
        if s < at:
            end = m.end()
            out.append((0, s, end))
    for m in _ip.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _card.finditer(text):
        digits = _not_digit.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _phone.finditer(text):
        if 8 <= len(_not_digit.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# The model ---------------------------------------------------------------


def encode(text: str) -> np.ndarray:
    """Code points as input symbols: ASCII by itself, other letters as one symbol, anything else as another."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 127, x, 127).astype(np.int64)


def _examples(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of generated text with tags: 0 outside, 1 + 2k first of kind k, 2 + 2k inside."""

    def pick(*of):
        return of[rng.integers(len(of))]

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def word(a=1, b=11):
        return (rng.integers(97, 123, rng.integers(a, b), dtype=np.uint8)).tobytes().decode()

    def card():
        # any number of that length looks like one; the check digit is tested after decoding
        d = digits(pick(16, 16, 16, 16, 17, 19))
        sep = pick("", "", " ", "-", ".", ".")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email():
        local = pick(word(2), word(2) + pick(".", "_", "") + word(2), word(2) + digits(2), word(1, 3) + "." + digits(3), word(9, 27) + pick(".", "_", "-") + word(9, 22))
        host = pick(word(3), word(3) + "." + word(3), word(3) + digits(1)) + "." + pick("com", "org", "net", "io", "de", "fr", "es", "example", word(2, 4))
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" [at] ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " dot "), (" [at] ", " [dot] "), (" @ ", "."))
        return local + at + host.replace(".", dot)

    def ip():
        sep = pick(".", ".", ".", "[.]")
        return sep.join(str(x) for x in rng.integers(0, 256, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{pick('1', digits(2))} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"+{digits(2)}{a}{b}{c}")

    def some(letters, k):
        return "".join(letters[c] for c in rng.integers(0, len(letters), k))

    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    others = (
        lambda: digits(4), lambda: digits(1) + "." + digits(1), lambda: digits(2) + "." + digits(1) + ".", lambda: "AKIA" + some(upper, 16),
        lambda: '"' + some(hexa, 32) + '"', lambda: "password=" + some(hexa, 16), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"${digits(2)}.{digits(2)}", lambda: "@" + word(3), lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: digits(6), lambda: digits(24),
        lambda: f"{digits(3)}-{digits(2)}", lambda: f"({digits(4)})", lambda: f"#{digits(5)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}",
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"[{digits(2)}]", lambda: f"{digits(2)}%",
    )

    def plain():
        kind = rng.integers(0, 5)
        w = word()
        return w if kind < 2 else w.capitalize() if kind == 2 else w.upper() if kind == 3 else "é" + w

    x, y = np.full((n, WINDOW), 32, np.int64), np.zeros((n, WINDOW), np.int64)
    makers = (email, ip, card, phone)
    for i in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            kind = rng.integers(0, 16)
            piece = makers[kind % 4]() if kind < 6 else pick(*others)() if kind < 10 else ""
            if kind < 6:
                own = [1 + 2 * (kind % 4)] + [2 + 2 * (kind % 4)] * (len(piece) - 1)
                tags += own
                # two of a kind that stand together
                if kind % 4 != 0 and rng.random() < 0.25:
                    more = makers[kind % 4]()
                    sep = pick(" ", " ", ",", ", ", "/", ";")
                    piece += sep + more
                    tags += [0] * len(sep) + [own[0]] + [2 + 2 * (kind % 4)] * (len(more) - 1)
            else:
                tags += [0] * len(piece)
            rest = pick(" ", " ", "\n", ". ", ", ", ": ") + " ".join(plain() for _ in range(rng.integers(1, 6))) + pick(" ", " ", " ", "\n", ": ", ". ", " (")
            text += piece + rest
            tags += [0] * len(rest)
        a = rng.integers(0, len(text) - WINDOW)
        x[i], y[i] = encode(text[a : a + WINDOW]), tags[a : a + WINDOW]
    return x, y


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, wx, wh, keep):
    """Hidden states of one direction over symbols x (rows, time)."""
    n, t, k = len(x), x.shape[1], wh.shape[0]
    h, c, states = np.zeros((n, k), wh.dtype), np.zeros((n, k), wh.dtype), []
    out = np.empty((n, t, k), wh.dtype)
    for i in range(t):
        z = wx[x[:, i]] + h @ wh
        g = _sigmoid(z[:, : 3 * k])
        u = np.tanh(z[:, 3 * k :])
        before, last = c, h
        c = g[:, k : 2 * k] * c + g[:, :k] * u
        s = np.tanh(c)
        h = g[:, 2 * k :] * s
        out[:, i] = h
        if keep:
            states.append((g, u, before, s, last))
    return out, states


def _lstm_back(x, wh, states, dout, symbols):
    n, t, k = dout.shape
    dwh, every = np.zeros_like(wh), np.empty((t, n, 4 * k), wh.dtype)
    dh, dc = np.zeros((n, k), wh.dtype), np.zeros((n, k), wh.dtype)
    for i in reversed(range(t)):
        g, u, before, s, last = states[i]
        dh = dh + dout[:, i]
        o = g[:, 2 * k :]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * u, dc * before, dh * s, dc * g[:, :k]], 1)
        dz[:, : 3 * k] *= g * (1 - g)
        dz[:, 3 * k :] *= 1 - u * u
        every[i] = dz
        dwh += last.T @ dz
        dh, dc = dz @ wh.T, dc * g[:, k : 2 * k]
    hot = np.zeros((symbols, t * n), wh.dtype)
    hot[x.T.ravel(), np.arange(t * n)] = 1
    return hot @ every.reshape(t * n, -1), dwh


def _crf(e, a):
    """Posteriors of tags, the log partition sums, and expected transitions, of emissions (rows, time, tags)."""
    n, t, k = e.shape
    top = e.max(2, keepdims=True)
    x, m = np.exp(e - top), np.exp(a)
    f, b, scale = np.empty_like(x), np.empty_like(x), np.empty((n, t), e.dtype)
    for i in range(t):
        y = x[:, i] if i == 0 else x[:, i] * (f[:, i - 1] @ m)
        scale[:, i] = y.sum(1)
        f[:, i] = y / scale[:, i, None]
    b[:, -1] = 1
    for i in reversed(range(t - 1)):
        b[:, i] = (x[:, i + 1] * b[:, i + 1]) @ m.T / scale[:, i + 1, None]
    after = x[:, 1:] * b[:, 1:] / scale[:, 1:, None]
    pair = m * (f[:, :-1].reshape(-1, k).T @ after.reshape(-1, k))
    return f * b, np.log(scale).sum(1) + top[:, :, 0].sum(1), pair


def emissions(model: dict, x: np.ndarray, keep: bool = False):
    left, ls = _lstm(x, model["wxf"], model["whf"], keep)
    right, rs = _lstm(x[:, ::-1], model["wxb"], model["whb"], keep)
    both = np.concatenate([left, right[:, ::-1]], 2)
    return both @ model["wo"] + model["bo"], both, ls, rs


@functools.cache
def trained(steps: int = 260, rows: int = 48, seed: int = 7) -> dict:
    """Train on ``steps * rows`` generated windows with Adam; the same weights each time."""
    rng = np.random.default_rng(seed)
    k, v = HIDDEN, 128
    m = {
        "wxf": rng.normal(0, 0.3, (v, 4 * k)), "whf": rng.normal(0, 0.2, (k, 4 * k)), "wxb": rng.normal(0, 0.3, (v, 4 * k)), "whb": rng.normal(0, 0.2, (k, 4 * k)),
        "wo": rng.normal(0, 0.2, (2 * k, TAGS)), "bo": np.zeros(TAGS), "a": np.zeros((TAGS, TAGS)),
    }
    m = {n: w.astype(np.float32) for n, w in m.items()}
    for name in ("wxf", "wxb"):
        m[name][:, k : 2 * k] += 1
    mean, var = {n: np.zeros_like(w) for n, w in m.items()}, {n: np.zeros_like(w) for n, w in m.items()}
    for step in range(1, steps + 1):
        x, y = _examples(rng, rows)
        e, both, ls, rs = emissions(m, x, keep=True)
        post, _, pair = _crf(e, m["a"])
        de = post
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
        de /= rows
        dboth = de @ m["wo"].T
        g = {"a": pair / rows, "wo": np.tensordot(both, de, ([0, 1], [0, 1])), "bo": de.sum((0, 1))}
        g["wxf"], g["whf"] = _lstm_back(x, m["whf"], ls, dboth[:, :, :k], v)
        g["wxb"], g["whb"] = _lstm_back(x[:, ::-1], m["whb"], rs, dboth[:, ::-1, k:], v)
        scale = min(1.0, 5 / (np.sqrt(sum((w * w).sum() for w in g.values())) + 1e-9))
        rate = np.float32(0.02 * min(1.0, 2 * (1 - step / (steps + 1))))
        for n, w in g.items():
            w = w * scale
            mean[n] = 0.9 * mean[n] + 0.1 * w
            var[n] = 0.99 * var[n] + 0.01 * w * w
            m[n] -= rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.99**step)) + 1e-8)
    return m


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around anchors; anchors whose margins meet share one."""
    out: list[list[int]] = []
    for m in _anchor.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _grid(n: int) -> list[int]:
    """Window starts that cover n characters with overlaps."""
    return [*range(0, max(1, n - STRIDE), STRIDE)]


#: Triangle weights: a window knows least at its ends.
_WEIGHT = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)


def model_spans(model: dict, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, posterior) that the model finds in each text."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    place, cut = [], []
    for i, text in enumerate(texts):
        for s, e in regions(text):
            x = encode(text[s:e])
            place.append((i, s, len(x)))
            cut.append(x)
    for first in range(0, len(place), 2048):
        _decode(model, texts, place[first : first + 2048], cut[first : first + 2048], found)
    return found


def _decode(model, texts, place, cut, found) -> None:
    grids = [_grid(len(x)) for x in cut]
    x = np.full((sum(map(len, grids)), WINDOW), 32, np.int64)
    row = 0
    for c, grid in zip(cut, grids, strict=True):
        for a in grid:
            part = c[a : a + WINDOW]
            x[row, : len(part)] = part
            row += 1
    e = np.concatenate([emissions(model, x[i : i + 4096])[0] for i in range(0, len(x), 4096)])
    merged, row = [], 0
    for c, grid in zip(cut, grids, strict=True):
        total, weight = np.zeros((len(c), TAGS), np.float32), np.zeros((len(c), 1), np.float32)
        for a in grid:
            n = min(WINDOW, len(c) - a)
            total[a : a + n] += e[row, :n] * _WEIGHT[:n, None]
            weight[a : a + n] += _WEIGHT[:n, None]
            row += 1
        merged.append(total / weight)
    order = sorted(range(len(cut)), key=lambda i: len(cut[i]))
    for first in range(0, len(order), 256):
        group = order[first : first + 256]
        longest = len(cut[group[-1]])
        padded = np.zeros((len(group), longest, TAGS), np.float32)
        padded[:, :, 1:] = -50
        for j, i in enumerate(group):
            padded[j, : len(merged[i])] = merged[i]
        path = _viterbi(padded, model["a"])
        hit = [j for j in range(len(group)) if path[j].any()]
        if not hit:
            continue
        post = _crf(padded[hit], model["a"])[0]
        for p, j in zip(post, hit, strict=True):
            i, start, n = place[group[j]]
            for kind, s, t in _spans(path[j][:n]):
                found[i].append((kind, start + s, start + t, float(p[np.arange(s, t), path[j][s:t]].mean())))


def _viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    n, t, k = e.shape
    back = np.zeros((n, t, k), np.int8)
    best = e[:, 0]
    for i in range(1, t):
        x = best[:, :, None] + a
        back[:, i] = x.argmax(1)
        best = x.max(1) + e[:, i]
    path = np.empty((n, t), np.int64)
    path[:, -1] = best.argmax(1)
    for i in reversed(range(1, t)):
        path[:, i - 1] = back[np.arange(n), i, path[:, i]]
    return path


def _spans(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    i, n = 0, len(tags)
    while i < n:
        if tags[i] % 2 == 1:
            kind, s = int(tags[i] - 1) // 2, i
            i += 1
            while i < n and tags[i] == 2 + 2 * kind:
                i += 1
            yield kind, s, i
        else:
            i += 1


def added_spans(text: str, base: list, found: list) -> list[tuple[int, int, int]]:
    """Model spans that are sure enough, have the digits of their kind, and keep clear of base spans and of each other."""
    out, taken = [], [(s, e) for _, s, e in base]
    for kind, s, e, p in sorted(found, key=lambda x: (-x[3], x[1])):
        piece = text[s:e]
        digits = _not_digit.sub("", piece)
        fits = (
            (len(piece) >= 6 and re.search(r"@|[\[(] ?at ?[\])]", piece) and re.search(r"\.|dot", piece)),
            re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}", piece) and all(int(x) <= 255 for x in re.findall("[0-9]+", piece)),
            16 <= len(digits) <= 19 and luhn(digits),
            8 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", piece) and re.search(r"[ ()+-]", piece),
        )[kind]
        inside = (s and text[s - 1].isalnum() and piece[0].isalnum()) or (e < len(text) and text[e].isalnum() and piece[-1].isalnum())
        if p >= LEAST_POSTERIOR and fits and not inside and all(e <= a or s >= b for a, b in taken):
            out.append((kind, s, e))
            taken.append((s, e))
    return out


def find(texts: list[str], model: dict | None = None) -> list[tuple[list, list]]:
    """Base and added spans of each text."""
    model = model or trained()
    base = [base_spans(t) for t in texts]
    return [(b, added_spans(t, b, f)) for t, b, f in zip(texts, base, model_spans(model, texts), strict=True)]


def _scan(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights = model.value
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        maybe = pc.match_substring_regex(text, ANCHOR)
        rows = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
        results = [([], [])] * batch.num_rows
        for first in range(0, len(rows), 200):
            some = rows[first : first + 200]
            for i, x in zip(some, find([text[int(i)].as_py() for i in some], weights), strict=True):
                results[i] = x
        counts = np.zeros((4, batch.num_rows), np.int64)
        for i in rows:
            for kind, _, _ in results[i][0]:
                counts[kind, i] += 1
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": counts[j] for j, k in enumerate(KINDS)},
                "base": pa.array([joined(b) for b, _ in results], pa.string()),
                "spans": pa.array([joined(b + a) for b, a in results], pa.string()),
                "n_added": np.array([len(a) for _, a in results], np.int64),
            }
        )


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts by kind and base spans (the fixed patterns), all spans, and how many the model added.

    Spans are ``kind:start:end`` in code points, end exclusive.  Null or empty
    texts have none; null ids, repeated rows and empty tables pass as they are;
    other columns are ignored; texts of any length are read whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(trained())
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _scan(it, model), f"doc_id {doc_type}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"
    )


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
