"""Operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, html, jaccard, langid, licenses, lines, neighbours, pieces, pii, quality, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, score string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   ", "\n\n", "one", "a b c d", "a b c d", "é😀 日本語 ▁x\ty", "word " * 5000, "x" * 20000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(ODD)] + [(None, "null id", None, None), (5, "a b c d", "en", "x")]
    return spark.createDataFrame(rows, DOCS)


# personal data


def naive_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "1", "23", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", " ", "-", "10.0.0.1", "x@y.z", "é", "(", "+"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == naive_base(t), t
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000) == []


def test_pii_model(spark, odd):
    model = pii.trained()
    x, y = pii._examples(np.random.default_rng(99), 300)
    p = pii._viterbi(pii.emissions(model, x)[0], model["a"])
    found, true = [set(pii._spans(r)) for r in p], [set(pii._spans(r)) for r in y]
    hits = sum(len(a & b) for a, b in zip(found, true, strict=True))
    assert hits / sum(map(len, found)) > 0.9 and hits / sum(map(len, true)) > 0.85
    # spans that no end of a window cuts
    found, true = [[{z for z in row if z[1] > 0 and z[2] < pii.WINDOW} for row in of] for of in (found, true)]
    hits = sum(len(a & b) for a, b in zip(found, true, strict=True))
    assert hits / sum(map(len, found)) > 0.95 and hits / sum(map(len, true)) > 0.95
    text = "é call (415) 555-0134 today, or a.b@c.org"
    ((base, added),) = pii.find([text], model)
    assert [text[s:e] for _, s, e in base] == ["a.b@c.org"] and [text[s:e] for k, s, e in added if k == 3] == ["(415) 555-0134"]
    # forms that the base patterns miss, and what looks like them
    forms = {
        "Pay 4465758382889437 4465758382889437 now": ["4465758382889437"] * 2, "call 415 555 0134 today": ["415 555 0134"], "host 10[.]0[.]0[.]1 up": ["10[.]0[.]0[.]1"],
        "write to averyveryverylongfirstname.andalonglastname [at] example.org please": ["averyveryverylongfirstname.andalonglastname [at] example.org"],
        "mail joe[at]site[dot]org now": ["joe[at]site[dot]org"],
        "in 2019 the 1234567890123456 count 12.5 and 3,000,000 at 10:30 on 2020-01-02 v1.2.3": [],
    }
    for text, (base, added) in zip(forms, pii.find(list(forms), model), strict=True):
        assert not base and [text[s:e] for _, s, e in sorted(added, key=lambda x: x[1])] == forms[text]
    rows = pii.pii_spans(odd).collect()
    assert len(rows) == 12 and all(r.spans == "" for r in rows)
    assert pii.pii_spans(odd.limit(0)).count() == 0
    text = "é call (415) 555-0134 today, or a.b@c.org"
    (r,) = pii.pii_spans(docs(spark, [text])).select("n_email", F.sha2("base", 256).alias("h")).collect()
    assert r.n_email == 1 and r.h == hashlib.sha256(f"email:{text.index('a.b')}:{len(text)}".encode()).hexdigest()


def test_windows_agree_with_one_long_window():
    text = "x " * 100 + "mail jane@site.org or +1 (555) 123-4567 now " + "y " * 100
    spans = pii.model_spans(pii.trained(), [text, text[50:]])
    assert [(k, s - 50, e - 50) for k, s, e, _ in spans[0]] == [(k, s, e) for k, s, e, _ in spans[1]]


# pieces


def test_pieces_round_trip(spark, odd):
    rows = pieces.decode(pieces.encode(odd)).collect()
    assert len(rows) == 12 and all(r.decoded == r.text for r in rows)
    assert next(r for r in rows if r.doc_id == 0).tokens is None
    same = {(r.doc_id, r.text): r.tokens for r in rows}
    assert all(same[r.doc_id, r.text] == r.tokens for r in pieces.encode(odd.repartition(7)).collect())
    assert pieces.encode(odd.limit(0)).count() == 0


def test_pieces_and_back_in_one_pass(spark, odd):
    apart = pieces.decode(pieces.encode(odd)).collect()
    once = pieces.round_trip(odd.withColumn("lossless", F.lit("x"))).collect()
    key = lambda r: (str(r.doc_id), r.tokens or b"", r.lang or "")
    assert sorted(map(key, once)) == sorted(map(key, apart))
    assert all(r.lossless for r in once) and "text" not in once[0]
    b = pa.record_batch({"doc_id": [1, 2, 3], "text": ["one", "two", None]})
    right = pieces.decode_tokens
    try:
        pieces.decode_tokens = lambda v, t: "one"
        assert next(pieces._round_trip(iter([b]), "doc_id", pieces.MODEL, 1.0, 0)).column("lossless").to_pylist() == [True, False, False]
    finally:
        pieces.decode_tokens = right
    assert pieces.round_trip(odd.limit(0)).count() == 0


def test_pieces_hold_one_worker(spark, tmp_path):
    """Each Python step of a plan is a worker more of every task, with a vocabulary of its own."""
    import corpus_pipeline

    docs(spark, ["one two", None]).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (registry.op2_pieces(spark, str(tmp_path)), corpus_pipeline.token_stage(spark, df, str(tmp_path))):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {r.doc_id: (r.n_tokens > 0, r.lossless) for r in out.collect()} == {0: (True, True), 1: (False, True)}


def test_pieces_follow_the_lattice():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    by = {b: i for i, b in enumerate(v.text) if b and np.isfinite(v.weight[i])}

    def paths(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if (i := by.get(s[:k].encode())) is not None:
                for p, x in paths(s[k:]):
                    yield (i, *p), v.weight[i] + x

    weight = dict(paths(" ther"))
    total = np.logaddexp.reduce(list(weight.values()))
    n, seen = 20000, defaultdict(int)
    for t in pieces.encode_texts(pieces.Lattices(v), list(range(n)), ["ther"] * n, 1):
        seen[tuple(np.frombuffer(t, "<i4").tolist())] += 1
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        share = np.exp(w - total)
        assert abs(seen[p] / n - share) < 4 * np.sqrt(share / n) + 1e-3
    other = pieces.encode_texts(pieces.Lattices(v), list(range(50)), ["there and then"] * 50, 2)
    assert other != pieces.encode_texts(pieces.Lattices(v), list(range(50)), ["there and then"] * 50, 3)


def test_long_words():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(rng.choice(letters) for _ in range(5_000_000))
    texts = [blob, "a" * 30_000, "語" * 30_000 + "é" * 500, " " * 20_000 + "x", "the" * 11 + " end"]
    out = pieces.encode_texts(pieces.Lattices(v), list(range(5)), texts, 0)
    assert [pieces.decode_tokens(v, t) for t in out] == texts
    # a cut stands wherever no piece reaches across, and nowhere else
    known = {t.decode() for t in v.text if t and not t.startswith(b"\x80") and _utf8(t)}
    word, at, cuts = blob[:3000], 0, set()
    for part in v.segments(word):
        at += len(part)
        cuts.add(at)
    for b in range(1, len(word)):
        crossed = any(word[i:j] in known for i in range(max(0, b - v.longest), b) for j in range(b + 1, min(len(word), i + v.longest) + 1))
        assert crossed == (b not in cuts)
    # a word is sampled alike whether it is summed up with others or by itself, walked or not
    lat = pieces.Lattices(v)
    size = pieces.ALONE + 7
    one, two = "ab" * (size // 2), "ba" * (size // 2)
    both = lat.sample(lat.look_up([one, two]), np.array([5, 6], np.uint64))
    alone = [pieces.Lattices(v) for _ in range(2)]
    each = [x.sample(x.look_up([w]), np.array([seed], np.uint64)) for x, w, seed in zip(alone, (one, two), (5, 6), strict=True)]
    assert both[0].tolist() == [*each[0][0].tolist(), *each[1][0].tolist()]


def _utf8(b):
    try:
        return bool(b.decode())
    except UnicodeDecodeError:
        return False


# decontamination

ITEM = "Alice has 12 apples and buys 7 more apples from Bob for 3 dollars each day. How many apples does Alice have now?"


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, ITEM, "c"), (2, None, "c"), (3, "", "c"), (4, "short item of words", "c")], "item_id long, text string, coverage string")
    texts = [
        "so " + ITEM + " bye", ITEM.replace("Alice", "Carol").replace("12", "30").replace("apples", "apples"), "Alice has 12 apples", "other words altogether that have nothing in common with it at all",
        ITEM.replace("\n", " ").upper(), "before short item of words after", ITEM.replace("Alice", "Zed").replace("dollars", "euros"),
        "Alice has 12 apples and buys 7 more pears for the whole family of nine people in Rome",
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 1), (4, 1), (5, 4), (6, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(docs(spark, texts), bench).collect()) == [2, 3, 7]
    title = decontaminate.find_leaks(docs(spark, [ITEM.title()]), bench.withColumn("item_id", F.col("item_id").cast("decimal(9,1)"))).collect()
    assert [(r.doc_id, float(r.item_id)) for r in title] == [(0, 1.0)]
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(odd.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.drop_leaking(odd, bench).count() == 12


def test_inconsistent_slots_do_not_match():
    item = "Ann gives Ben 5 pens and then Ben gives Ann 5 cups because Ann and Ben share 5 things"
    index = decontaminate.Index([1], [item])
    shuffled = "Bob gives Cid 1 pens and then Dan gives Eve 2 cups because Fay and Gus share 3 things"
    renamed = item.replace("Ann", "Bob").replace("Ben", "Cid").replace("5", "9")
    got = list(decontaminate.leaks_of(pa.array([shuffled, renamed]), index))
    assert got[0] == [] and [x[0] for x in got[1]] == [1]


def test_exact_copies_of_any_item():
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200))
    items = ["12 + 7 * 3 - 4 = 29, 5 * 6 / 2 = 15", "Anna Berg, Carl Dahl, Eva Falk, Gustav Holm, Ida Juhl", "Mount Everest", "42 + 17", long]
    index = decontaminate.Index(list(range(5)), items)
    texts = [f"some words {x} and more" for x in items[:4]] + ["x " + " ".join(long.split()[40:130]) + " y", "x " + " ".join(long.split()[40:85]) + " y"]
    texts += ["12 + 7 * 3 - 4 = 30, 5 * 6 / 3 = 10", "Mount", "Everest Mount 17 42", None]
    got = [[x[0] for x in found] for found in decontaminate.leaks_of(pa.array(texts), index)]
    assert got == [[0], [1], [2], [3], [4], [], [], [], [], []]


# language


@pytest.mark.parametrize("order", [2, langid.ORDER])
def test_code_lengths_are_those_of_the_trees(order):
    texts = {"x": [b"abracadabra", b"abra abracadabra"], "y": [b"cadcad cad cadabra"]}
    model = langid.train(texts, order=order)

    def seen(c):
        """Whether some language has a context often enough to keep it."""
        return len(c) < 3 or any(sum(t[i : i + len(c)] == c for t in ts for i in range(len(t) - len(c))) >= langid.LEAST_SEEN for ts in texts.values())

    def bits(g, context, symbol):
        for n in range(min(order, len(context)), -1, -1):
            c = context[len(context) - n :]
            if not seen(c):
                continue
            follow = defaultdict(int)
            for t in texts[g]:
                for i in range(n, len(t)):
                    if t[i - n : i] == c:
                        follow[t[i]] += 1
            total, kinds = sum(follow.values()), len(follow)
            if not total:
                continue
            if symbol in follow:
                return np.log2((total + kinds) / follow[symbol])
            return np.log2((total + kinds) / kinds) + (bits(g, context[len(context) - n + 1 :], symbol) if n else 8.0)
        return 8.0

    for t in (b"abrz cad", b"", b"q", b"dabra"):
        got = langid.code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        want = [sum(bits(g, t[max(0, i - order) : i], t[i]) for i in range(len(t))) for g in ("x", "y")]
        assert got == pytest.approx(want, abs=1e-4)


def test_language(spark, odd):
    out = registry.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out & out.lang.notna()]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.95
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    model = langid.train({"a": [b"hello there"], "b": [b"guten tag"]})
    rows = {(r.doc_id, r.text_len): r for r in langid.identify(odd.select("doc_id", F.length("text").alias("text_len"), "text"), model).collect()}
    assert rows[0, None].lang_pred == "und" and rows[2, 3].score == 0.0 and len(rows) >= 11
    assert {r.lang_pred for r in langid.identify(odd.select("doc_id", "text"), langid.train({})).collect()} == {"und"}
    clash = langid.identify(odd.select("doc_id", "text", "score", F.lit(1).alias("lang_pred")), model)
    assert clash.columns == ["doc_id", "lang_pred", "score"] and clash.select("score").count() == 12


# lines


def naive_templates(rows):
    """The template of each distinct line (by its text), and the documents of each template."""
    plain, digit = {}, re.compile("[0-9]")
    docs_of = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            w = WORD.findall(line)
            if re.search(r"[^\W_]", line):
                masked = tuple("<*>" if digit.search(x) else x for x in w)
                plain[line] = masked if len(w) - masked.count("<*>") >= 2 else ("as it is", *w)
                docs_of[plain[line]].add(i)
    leaves = defaultdict(list)
    for k, d in docs_of.items():
        if len(d) < 3 and len(k) > 3 and k[0] != "as it is" and len(k) - k.count("<*>") >= 5:
            leaves[len(k), k[:3]].append(k)
    general = {}
    for leaf, ks in leaves.items():
        seen = defaultdict(int)
        for k in ks:
            for p, x in enumerate(k):
                seen[p, x] += len(docs_of[k])
        for k in ks:
            literal = tuple((p, x) for p, x in enumerate(k) if seen[p, x] >= 3)
            words = sum(x != "<*>" for _, x in literal)
            if words >= 5 and words >= 0.7 * len(k):
                general[k] = (leaf, literal)
    members = defaultdict(set)
    for k, g in general.items():
        members[g] |= docs_of[k]
    template = {k: general[k] if k in general and len(members[general[k]]) >= 3 else k for k in docs_of}
    where = defaultdict(set)
    for k, t in template.items():
        where[t] |= docs_of[k]
    return {line: template[k] for line, k in plain.items()}, where


def naive_lines(rows, leave=1.0):
    template, where = naive_templates(rows)
    out = {}
    for i, t in rows:
        parts = t.split("\n")
        gone = [x in template and len(where[template[x]]) >= 3 and min(where[template[x]]) != i for x in parts]
        lost = sum(len(WORD.findall(x)) for x, g in zip(parts, gone, strict=True) if g)
        out[i] = t if lost > leave * len(WORD.findall(t)) else "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
    return out


def test_lines(spark, odd):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab cd ef gh 12 ij7 --".split()) for _ in range(rng.randint(0, 11))) for _ in range(60)]
    pool += [" ".join(["q", "r", "s", *(rng.choice("tuvw") + "x" * rng.choice((0, 0, 0, rng.randrange(99))) for _ in range(n))]) for n in (3, 5, 8, 8, 8) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(160)]
    names = "ann bob cy dan eve".split()
    rows += [(1000 + i, f"session opened for {x} from the host {y} at noon today\nown line number x{x} stays") for i, (x, y) in enumerate(zip(names, "h k m n o".split(), strict=True))]
    # each of the first document's line's fields has another owner elsewhere: some line of the template must stay
    rows += [(2000 + i, f"a job ended {a} with the state {b} on the old queue") for i, (a, b) in enumerate([("p", "x"), ("q", "x"), ("p", "y"), ("r", "x"), ("p", "z"), ("s", "x")])]
    rows += [(3000 + i, f"{i} 4 {i}5\n77 8") for i in range(5)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_dropped string")
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(df).collect()}
    assert got == naive_lines(rows)
    assert got[1001] == "own line number xbob stays" and got[1000].startswith("session opened for ann")
    assert [got[3000 + i] for i in range(3)] == ["0 4 05\n77 8", "1 4 15", "2 4 25"]
    # of every template that lost lines a line stays
    template, where = naive_templates(rows)
    kept = {template.get(x) for t in got.values() for x in t.split("\n")}
    assert all(template[x] in kept for _, t in rows for x in t.split("\n") if x in template)
    half = {r.doc_id: r.text for r in lines.drop_recurring_lines(df, leave=0.5).collect()}
    assert half == naive_lines(rows, 0.5) and half != got
    out = lines.drop_recurring_lines(odd).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(r.text) for r in odd.collect())
    assert lines.drop_recurring_lines(odd.limit(0)).count() == 0


def test_passages(spark, odd):
    rng = random.Random(7)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    passage, two, short = prose(90), prose(30) + "\n" + prose(40), prose(49)
    texts = [f"{prose(40)} {passage} end", f"{two}\n{short}", f"begin {passage} {short} tail", f"head\n{two}\nlast", passage, None, f"a {prose(300)}"]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[1] == (texts[1], 0) and got[5] == (None, 0) and got[6] == (texts[6], 0)
    assert got[2] == (f"begin {short} tail", 0) and got[3] == ("head\nlast", 2) and got[4] == ("", 1)
    # against every run of some texts with long common parts
    parts = [prose(n) for n in (12, 35, 49, 50, 51, 120)]
    texts = ["\n".join(rng.choice(parts) + rng.choice(["", " x"]) for _ in range(5)) for _ in range(40)]
    got = {r.doc_id: r.text.split() for r in lines.drop_repeated_passages(docs(spark, texts)).collect()}
    owner = {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if owner.setdefault(tuple(w[p : p + 50]), i) != i:
                gone[p : p + 50] = [True] * 50
        assert got[i] == [x for x, g in zip(w, gone, strict=True) if not g]
    again = lines.drop_repeated_passages(docs(spark, ["a b " * 300, f"c {prose(60)}", "b a " * 90]).withColumn("_spans", F.lit(1)).withColumn("n_cut", F.lit("x"))).collect()
    assert {r.doc_id: (len(r.text.split()), r.n_cut) for r in again}[2] == (0, 180)
    out = lines.drop_repeated_passages(odd).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(r.text) for r in odd.collect())
    assert lines.drop_repeated_passages(odd.limit(0)).count() == 0


def test_lines_and_passages_hash_words_once(monkeypatch):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(30)) for _ in range(6)) for _ in range(20)] + [None, ""]
    batch = pa.record_batch({"doc_id": pa.array(range(22)), "key": pa.array(range(22)), "text": pa.array(texts, pa.string())})
    calls, words = [], lines._text.words
    monkeypatch.setattr(lines._text, "words", lambda *a, **k: calls.append(1) or words(*a, **k))
    both = pa.Table.from_batches(lines._read(iter([batch]), (lines.LINE, lines.ANCHORED))).to_pylist()
    assert len(calls) == 1 and {r["kind"] for r in both} == {lines.LINE, lines.ANCHORED}
    # each row's places are those of its line
    for r in both:
        if r["kind"] == lines.LINE:
            parts = texts[r["doc_id"]].split("\n")
            assert [k for k, t in enumerate(parts) if t == parts[r["places"][0]]] == r["places"]


def test_words_of_long_and_short_blocks(monkeypatch):
    text = ("Some wörds\tand 12 \n\n others, " * 300).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, 7, 7, len(text)])
    short = lines._text.words(data, off)
    monkeypatch.setattr(lines._text, "CHUNK_BYTES", 10)
    assert all((a == b).all() for a, b in zip(short, lines._text.words(data, off), strict=True))


def test_texts_that_lose_nothing_stay_out_of_python(spark):
    """Their lines are counted by Spark, and what goes is found by its place."""
    texts = ["a b c", "", "\n\n", None, "x\ny\n", "same line here\nown é", "same line here\nother", "third\nsame line here\nsame line here"]
    out = lines.dedup_lines(docs(spark, texts))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("MapInArrow") == 1
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.n_cut) for r in out.collect()}
    assert got == {
        0: ("a b c", 1, 0, 0), 1: ("", 1, 0, 0), 2: ("\n\n", 3, 0, 0), 3: (None, 0, 0, 0), 4: ("x\ny\n", 3, 0, 0),
        5: (texts[5], 2, 0, 0), 6: ("other", 2, 1, 0), 7: ("third", 3, 2, 0),
    }


# quality


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.1"
    out = registry.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 300
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98 and (held[held.quality == 0].predicted == 0).mean() > 0.85
    model = quality.train([b"good words here " * 20] * 20, [b"BAD!! BAD!! " * 20] * 20)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd.limit(0), model).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(odd, quality.train([], [])).collect())


# html

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id="mainNav"><a>Home</a></div>
<div class="content"><p>First para &amp; more<br>line <b>bold</b>ed.<p>Second<div class="sidebar-right">side</div><ul><li>one<li>two</ul></div><form>x<input name=q></form>
<div class="comments"><p>nice post</p></div><section id=ads><p>buy</p></section><script>var a="</p>";</script><!-- <p>no</p> --><footer>f</footer></body></html>"""


def test_markup():
    assert " ".join(t for _, t in html.blocks(PAGE)) == "First para & more line bolded. Second one two"
    assert html.blocks("") == [] and html.blocks("plain  text\n") == [(False, "plain text")]
    got = html.blocks("<body><p>out<article><header><h1>T</h1></header><p><b>a<br><p>b</b> c</p><aside>x</aside></article><p>z")
    assert [t for inside, t in got if inside] == ["T", "a", "b c"]
    assert html.blocks("<p>a &lt;b&gt; &#233; &copy;")[0][1] == "a <b> é ©"
    assert html.blocks("<p>" * 20000 + "x")[-1][1] == "x"
    kept = (
        '<section aria-label="a hidden gem"><p>body text</p></section>', '<a title="the hidden valley">body text</a>', '<div class="a hidden b">body text</div>', '<div class="post-header">body text</div>',
        '<p class="form-text">body text</p>', '<div id="search-algorithms">body text</div>', '<p class="ad-hoc">body text</p>', '<div class="related-work">body text</div>', "<p title=don't>body text</p>",
        '<p class="x>body text', "<p data-style='display:none'>body text</p>",
    )
    for page in kept:
        assert html.blocks(f"<article>{page}</article>" if page.endswith(">") else page)[0][1] == "body text", page
    for page in ("<div hidden>x</div>", '<div style="display: none">x</div>', '<div class="mainNav">x</div>', "<div id=comment-12>x</div>", '<div class="related-posts">x</div>', '<div aria-hidden="true">x</div>', "<div class='b sidebar-right'>x</div>"):
        assert html.blocks(f"<article>{page}</article>") == [], page


def test_suffix_array_marks_what_pages_share():
    rng = random.Random(2)
    for _ in range(40):
        pages = [[[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
        pages = [list(map(list, p)) for p in dict.fromkeys(tuple(map(tuple, p)) for p in pages)]
        grams = defaultdict(set)
        for i, p in enumerate(pages):
            for b in p:
                for k in range(len(b)):
                    grams[tuple(b[k : k + html.LEAST_TOKENS])].add(i)
                if len(b) < html.LEAST_TOKENS:
                    grams["whole", *b].add(i)
        for p, marks in zip(pages, html.covered(pages), strict=True):
            for b, m in zip(p, marks, strict=True):
                want = np.zeros(len(b), bool)
                for k in range(len(b) - html.LEAST_TOKENS + 1):
                    if len(grams[tuple(b[k : k + html.LEAST_TOKENS])]) > 1:
                        want[k : k + html.LEAST_TOKENS] = True
                if len(b) < html.LEAST_TOKENS and len(grams["whole", *b]) > 1:
                    want[:] = True
                assert m.tolist() == want.tolist()


def test_html(spark):
    menu = "<div><p>home news about contact imprint sitemap search</p></div>"
    rows = [(i, f"http://a.org/{i}", f"{menu}<p>unique text {' '.join(f'w{i}x{k}' for k in range(30))}</p><p>imprint</p>", "k") for i in range(6)]
    rows += [(10, None, None, "k"), (11, "http://b.org", "", "k"), (12, "http://a.org/9", rows[0][2], "k"), (13, "http://c.org", f"{menu}<p>alone</p>", "k"), (14, "http://a.org/x", "<article>home news about contact imprint sitemap search</article>", "k")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(out) == 11 and out[10] == out[11] == ""
    assert out[1] == "unique text " + " ".join(f"w1x{k}" for k in range(30)) and out[12] == out[0]
    assert out[13].startswith("home news") and out[14].startswith("home news")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_text_beside_an_article(spark):
    rng = random.Random(5)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    slogan, banner = "all the news of the day", prose(15)
    rows, want = [], {}
    for i in range(30):
        a, b, c, d = prose(20), prose(9), prose(25), prose(3)
        rows.append((i, f"http://a.org/{i}", f"<div>{slogan}</div><p>{a}<article><h1>{b}</h1></article><div>{banner} {d}</div><main><p>{c}</main><p>{banner}"))
        want[i] = f"{a} {b} {d} {c}"
    # equal open text beside other articles is shared by distinct pages; beside the same article the page is the same
    rows += [(100 + i, "http://b.org/x", f"<p>{slogan}</p><article>{'one' if i < 2 else 'two'}</article>") for i in range(3)]
    rows += [(200 + i, "http://c.org/x", f"<article>one</article><p>{slogan}</p>") for i in range(2)]
    rows += [(300, "http://d.org/x", "<article>one</article><nav>menu</nav><article> </article>")]
    want |= {100: "one", 101: "one", 102: "two", 200: f"one {slogan}", 201: f"one {slogan}", 300: "one"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (html.GROUP, 60):
        assert {r.page_id: r.text for r in html.extract(pages, group).collect()} == want


def test_html_split_host(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    menu, banner, phrase = "home news about", prose(14), prose(7)
    own = [(prose(20), prose(20)) for _ in range(40)]
    rows = [(i, f"http://a.org/{i}", f"<p>{menu}<p>{a} {banner if i in (3, 30) else phrase if i in (5, 25) else ''} {b}") for i, (a, b) in enumerate(own)]
    want = {i: f"{a} {phrase} {b}" if i in (5, 25) else f"{a} {b}" for i, (a, b) in enumerate(own)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (html.GROUP, 60):
        assert {r.page_id: r.text for r in html.extract(pages, group).collect()} == want


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in x[i]], "l") for i in range(600)] + [(700, None, "l"), (800, [0.0] * 16, "l"), (900, [float("nan")] * 16, "l"), (1000, [1.0], "l"), (None, [1.0] * 16, "l"), (5, [float(v) for v in x[5]], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = neighbours.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    assert sorted(out.query_id.unique()) == [0, 100, 200, 300, 400, 500]
    hit = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(600) if i != q)[:10]
        g = g.sort_values("rank")
        assert len(g) == 10 and list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True)) and (g.score.values == d[g.vec_id.values]).all()
        hit += len({i for _, i in best} & set(g.vec_id))
    assert hit >= 0.9 * 60
    few = df.where("vec_id < 4")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 3
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0 and neighbours.nearest(df.where("vec_id = 700"), df).count() == 0


def test_forest_reads_a_small_share():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trees = neighbours.grow(x[: neighbours.SAMPLE], neighbours.TREES, 11)
    q = x[::250]
    count, hits, read, compared = 2**11, 0, 0, 0
    place = np.stack([neighbours.leaves(tree, x) + t * count for t, tree in enumerate(trees)], 1)
    for k, chosen in enumerate(neighbours.chosen_leaves(trees, q, neighbours.SHARE)):
        wanted = np.zeros(count * len(trees), bool)
        wanted[chosen] = True
        seen = wanted[place]
        d = ((x - q[k]) ** 2).sum(1)
        d[k * 250] = np.inf
        hits += seen[np.argsort(d)[:10]].any(1).sum()
        read += seen.any(1).mean()
        compared += seen.sum() / len(x)
    assert hits >= 0.9 * 10 * len(q), hits / len(q) / 10
    assert read / len(q) < 0.26 and compared / len(q) < 0.4, (read / len(q), compared / len(q))
    print("recall", hits / len(q) / 10, "read", read / len(q), "compared", compared / len(q))


# licences


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.", "k"), ("a/b/x.txt", "no header here", "k"), ("a/b/c/y.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore", "k"), ("a/b/LICENSE.md", "copyright law in general is a topic of many books", "k"),
        ("z/q.txt", None, "k"), ("z/r.txt", "", "k"), (None, "All rights reserved.", "k"), ("a/b/x.txt", "no header here", "k"), ("ab/x.txt", "plain", "k"), ("a/long.txt", "word " * 20000, "k"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string, license string")).collect()
    assert len(out) == 10
    by = {r.path: (r.own_license, r.license, r.license_dir) for r in out}
    assert by["a/b/x.txt"] == (None, "MIT", "a") and by["a/b/c/y.txt"] == ("Apache-2.0", "Apache-2.0", None) and by["a/b/LICENSE.md"] == (None, "MIT", "a")
    assert by["z/q.txt"] == by["z/r.txt"] == by["ab/x.txt"] == (None, None, None) and by[None] == ("All-Rights-Reserved",) * 2 + (None,)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0
    top = [("LICENSE", "SPDX-License-Identifier: MIT"), ("x.txt", "a"), ("d/e/y.txt", "b"), ("d/COPYING", "// SPDX-License-Identifier: Apache-2.0"), ("d/z.txt", "c"), (None, "d")]
    by = {r.path: (r.license, r.license_dir) for r in licenses.scan(spark.createDataFrame(top, "path string, text string")).collect()}
    assert by == {"LICENSE": ("MIT", None), "x.txt": ("MIT", ""), "d/e/y.txt": ("Apache-2.0", "d"), "d/COPYING": ("Apache-2.0", None), "d/z.txt": ("Apache-2.0", "d"), None: (None, None)}


# Jaccard join


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, odd):
    rng = random.Random(4)
    base = [[rng.choice(["the", "a", "of"] + [f"w{k}" for k in range(400)]) for _ in range(n)] for n in (3, 5, 12, 40, 60, 150, 300)]
    rows = []
    for b in base:
        for _ in range(24):
            w = list(b)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, len(b) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), (" " if rng.random() < 0.2 else "") + " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    passage = " ".join(base[5])
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}x{k}" for k in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "1 2 3 4"), (2005, "1 2 3 4 5")]
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    out = jaccard.jaccard_classes(odd).collect()
    assert len(out) == 12 and {r.component_id for r in out if r.doc_id in (5, 6)} == {5}
    assert jaccard.jaccard_classes(odd.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(6)
    pool = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for share in (0.0, 0.3, 0.9, 1.0):
        # how many sets hold each token: some are in two, others in many
        held = np.where(rng.random(len(pool)) < share, rng.integers(17, 400, len(pool)), rng.integers(2, 9, len(pool)))
        count = lambda s: held[np.searchsorted(pool, s)]
        for _ in range(300):
            n = int(rng.integers(1, 250))
            x = np.sort(rng.choice(pool, n, replace=False))
            k = int(rng.integers(0, max(1, n // 6) + 1))
            y = np.unique(np.concatenate([rng.choice(x, n - k, replace=False), rng.choice(pool, int(rng.integers(0, k + 1)))]))
            c = len(np.intersect1d(x, y))
            if 100 * c >= 75 * (len(x) + len(y) - c):
                assert len(np.intersect1d(jaccard.signatures(x, count(x)), jaccard.signatures(y, count(y))))
            assert jaccard.bitmap_differs(jaccard.bitmap(x), jaccard.bitmap(y)) <= len(x) + len(y) - 2 * c


def test_counts_of_blocks():
    rng = np.random.default_rng(8)
    tokens = [np.unique(rng.integers(0, 400, 150)).astype(np.uint64) for _ in range(9)]
    owners = [np.where(rng.random(len(t)) < 0.2, jaccard._NO_SET, rng.integers(0, 4, len(t))).astype(np.uint16) for t in tokens]
    group = pa.table({"block": list(range(9)), "tokens": [t.tobytes() for t in tokens], "owner": [o.tobytes() for o in owners]}, pa.schema([("block", pa.int64()), ("tokens", pa.binary()), ("owner", pa.binary())]))
    want = defaultdict(int)
    for b, (t, o) in enumerate(zip(tokens, owners, strict=True)):
        for x, i in zip(t.tolist(), o.tolist(), strict=True):
            if i != jaccard._NO_SET and any(x in other for k, other in enumerate(tokens) if k != b):
                want[b, i] += 1
    parts = jaccard._shared(group)
    got = {}
    for b in range(9):
        mine = parts.filter(pa.array([x == b for x in parts["block"].to_pylist()]))
        got |= {(r["block"], r["idx"]): r["shared"] for r in jaccard._summed(pa.concat_tables([mine, mine.slice(0, 0)])).to_pylist()}
    assert got == want
    counts = [rng.integers(1, 3, len(t)).astype(np.uint32) for t in tokens]
    out = jaccard._counted(group.drop(["owner"]).append_column("counts", pa.array([n.tobytes() for n in counts], pa.binary()))).to_pylist()
    total = defaultdict(int)
    for t, n in zip(tokens, counts, strict=True):
        for x, k in zip(t.tolist(), n.tolist(), strict=True):
            total[x] += k
    for t, r in zip(tokens, out, strict=True):
        assert dict(zip(np.frombuffer(r["tokens"], np.uint64).tolist(), np.frombuffer(r["counts"], np.uint32).tolist(), strict=True)) == {x: total[x] for x in t.tolist() if total[x] > 1}


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 300").select("text").first().text
    texts = [None, "", "  ", "one", first, first, "x" * 20000, "tie one two three four five six"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped int, _spans int, key string, node long, tokens string, `a b` string"
    rows = [(i, t, None, "s", len(t or ""), f"s{i}", i, i, "k", i, "t", "z") for i, t in enumerate(texts)]
    rows += [rows[4], rows[0], (None, "no id", "en", None, None, "s", None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert stage(spark, df.limit(0), sf).count() == 0
        if name == "sentencepiece":
            assert out.where("not lossless").count() == 0 and out.count() == len(rows)
            continue
        assert out.columns == df.columns
        got = out.collect()
        assert all(r.score == f"s{r.doc_id}" and r.n_dropped == r.doc_id for r in got if r.doc_id is not None)
        if name == "jaccard_join":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 0, 1, 2, 3, 4, 4, 6, 7]
        elif name != "quality_classifier":
            assert len(got) == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    inputs, df = {}, spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        df = stage(spark, df, sf).checkpoint()
        if name != "sentencepiece":
            assert df.columns == columns
    final = df.collect()
    assert all(r.lossless for r in final)
    assert inputs["jaccard_join"] != inputs["line_dedup"]
    want = naive_lines(sorted(inputs["line_dedup"].items()), corpus_pipeline.LEAVE_COPIES)
    assert inputs["jaccard_join"] == {i: t for i, t in want.items() if t.strip() or t == inputs["line_dedup"][i]}
    classes = brute(sorted(inputs["jaccard_join"].items()))
    assert inputs["decontamination"].keys() == {i for i, (_, c) in classes.items() if c == i}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {i for i, t in inputs["decontamination"].items() if any(x in " ".join(t.split()) for x in items)}
    assert {r.doc_id for r in final} == inputs["decontamination"].keys() - leaking
