"""Language identification, periodic runs and spelling variants against brute force, on tables with every awkward case."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import language_id, oracle, periodic_runs, queries, spelling_variants

DATA = "/root/testdata/sf0.001"
CLASH = ("lang_pred", "score", "n", "k", "run", "word", "root", "runs", "w", "a.b", "back`tick")


def table(spark, rows, more=()):
    """doc_id, text and what `more` names, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {c} string" for c in more))
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- periodic runs ----------------------------------------------------------------------------------------------


def plain_runs(w, least, times):
    """Every period by itself: unbroken stretches of equal words q apart; the least period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def mixed_words(r):
    """A string over few letters with repeats of several periods and copies of its own parts."""
    w = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 4)):
        if len(w) < 4:
            break
        p, s = r.randint(1, 6), r.randrange(len(w))
        for i in range(max(s, p), min(len(w), s + r.randint(1, 40))):
            w[i] = w[i - p]
        s, d = r.randrange(len(w)), r.randrange(len(w))
        w = w[:d] + w[s : s + r.randint(1, 30)] + w[d:]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(400):
        w = mixed_words(r)
        for least, times in ((1, 2), (8, 2), (6, 3), (24, 3)):
            assert periodic_runs.runs([bytes([x]) for x in w], least, times) == plain_runs(w, least, times), (w, least, times)


def test_all_short_words_over_two_letters():
    for n in range(13):
        for w in itertools.product((0, 1), repeat=n):
            assert periodic_runs.runs_of(w, 1, 2) == plain_runs(w, 1, 2)


def test_factors():
    r = random.Random(3)
    for _ in range(200):
        w = mixed_words(r)
        place = 0
        for a, b, first in periodic_runs.factors(w):
            assert a == place
            occurs = lambda n: any(w[s : s + n] == w[a : a + n] for s in range(a))  # noqa: B023, E731
            if first == a:
                assert b == a + 1 and not occurs(1)
            else:
                assert first < a and w[first : first + b - a] == w[a:b] and (b == len(w) or not occurs(b - a + 1))
            place = b
        assert place == len(w)


def test_long_texts_take_linear_work():
    w = [b"x%d" % (i % 997) for i in range(60_000)]
    assert periodic_runs.runs(w) == [(0, 60_000, 997)]
    assert periodic_runs.runs([b"a"] * 60_000) == [(0, 60_000, 1)]


RUN_ROWS = [
    (None, "a b " * 20),
    (0, None),
    (1, ""),
    (2, " \t\n\x0b "),
    (3, "one"),
    (4, "go on " * 12),
    (4, "go on " * 12),
    (5, "x " * 23),
    (6, "x " * 24),
    (7, "a b c d e f g h " * 3 + "z " + "p q " * 15 + "r " + "p q " * 15),
    (8, ("u v w " * 9 + "k l ") * 5),
    (9, "é\xa0ß " * 30 + "\x1c"),
    *[(k, " ".join(f"w{(7 * i + k) % 37}" for i in range(60 + k))) for k in range(10, 60)],
    (60, " ".join(f"v{i}" for i in range(20_000)) + " end" * 100),
]


def turned(doc, words):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs_query(spark):
    want = []
    for d, t in RUN_ROWS:
        w = turned(d, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        found = plain_runs(w, 24, 3)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        s, n, q = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        lines = "".join(f"{x[0]},{x[1]},{x[2]}\n" for x in sorted(found, key=lambda x: (x[0], x[2])))
        want.append((d, len(found), s, n, q, 1000 * n // q if found else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.with_repeats(table(spark, RUN_ROWS))))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    assert sum(x[1] > 0 for x in want) > 8


def test_collapsed_text(spark):
    rows = periodic_runs.find(table(spark, [(1, "start " + "go on " * 15 + "stop")])).collect()
    assert [tuple(x) for x in rows[0]["runs"]] == [(1, 30, 2)] and rows[0]["collapsed"] == "start go on stop" and rows[0]["n_words"] == 32


def test_periodic_runs_of_no_documents(spark):
    assert periodic_runs.find(table(spark, [])).collect() == []


# --- spelling variants ------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor=10):
    out = set()
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def edited(r, w, letters):
    i = r.randrange(len(w))
    return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdéß", "aeinrst"])
def test_variants_of_random_words(spark, letters):
    """Few letters give words whose bigrams repeat and are all frequent."""
    r = random.Random(len(letters))
    counts = {}
    for _ in range(60):
        w = "".join(r.choice(letters) for _ in range(r.randint(7, 12)))
        for _ in range(6):
            counts.setdefault(w, r.choice([2, 3, 20, 30, 250, 2500, 30_000]))
            w = edited(r, w, letters)
            if len(w) < 7:
                break
    got = spelling_variants.variants(spark.createDataFrame([*counts.items(), (None, 5)], "word string, n bigint"))
    assert {tuple(x) for x in got.collect()} == plain_variants(counts)
    assert sum(x[4] > 0 for x in plain_variants(counts)) > 50


def test_ways_of_many_steps(spark):
    """Forms of forms: each ten times as frequent as the one before."""
    words = ["a" * k + "b" * (12 - k) for k in range(10)]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    assert {x.root for x in got.collect()} == {words[-1]} and {tuple(x) for x in got.collect()} == plain_variants(counts)


WORD_ROWS = [(None, "Ünïcödé"), (0, None), (1, ""), (2, "short word"), (3, "x" * 5000 + " " + "x" * 5000)]
WORD_ROWS += [(k, "Strasse STRAßE Straßen straßen×÷ élégante Élégante bananan" + " computer" * (k % 7) + (" computr komputer" if k % 9 == 0 else "") + " 9computers9") for k in range(4, 80)]


def test_spelling_variants_query(spark):
    lower = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    counts = collections.Counter()
    for d, t in WORD_ROWS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = spelling_variants.counted(spelling_variants.with_deletions(spelling_variants.runs(table(spark, WORD_ROWS))))
    assert {tuple(x) for x in spelling_variants.variants(found).collect()} == plain_variants(kept)
    assert len(kept) > 8 and any(len(w) == 5000 for w in kept)


def test_spelling_variants_of_no_documents(spark):
    found = spelling_variants.counted(spelling_variants.runs(table(spark, [])))
    assert spelling_variants.variants(found).collect() == []


# --- language identification ------------------------------------------------------------------------------------


def test_states_and_gradients():
    """Against a plain loop over bytes, and against finite differences."""
    r = np.random.default_rng(1)
    net = language_id.Network(3, 4)
    x, size, label = r.integers(0, 5, (7, 6)).astype(np.uint8), np.array([7, 3, 5, 7, 1, 6]), np.array([0, 1, 2, 0, 1, 2])

    def plain(side):
        h, w = net.units, net.w
        out = np.zeros((7, h, 6))
        for lane in range(6):
            state = np.zeros(h)
            for t in range(size[lane]) if side == 0 else range(size[lane] - 1, -1, -1):
                a, u = w["in"][side][:, x[t, lane]].astype(float), w["on"][side].astype(float) @ state
                z, reset = (1 / (1 + np.exp(-(a[k * h : (k + 1) * h] + u[k * h : (k + 1) * h]))) for k in (0, 1))
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + reset * u[2 * h :])
                out[t, :, lane] = state
        return out

    def states(self, x, size, side):
        return plain(side)

    for side in (0, 1):
        got, want = net.states(x, size, side), plain(side)
        for lane in range(6):
            assert np.abs(got[: size[lane], :, lane] - want[: size[lane], :, lane]).max() < 1e-5
    exact = language_id.Network(3, 4)
    exact.w = net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    exact.states = states.__get__(exact)
    grad = exact.loss(x, size, label)[1]
    for name, values in exact.w.items():
        for _ in range(8):
            at = tuple(int(r.integers(0, n)) for n in values.shape)
            at = (*at[:2], at[2] % 5) if name == "in" else at
            old = values[at]
            values[at] = old + 1e-5
            up = exact.loss(x, size, label)[0]
            values[at] = old - 1e-5
            down = exact.loss(x, size, label)[0]
            values[at] = old
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5


@pytest.mark.parametrize("sizes", [[0], [1, 0, 192, 193, 1000, 384, 0], [5000]])
def test_stretches_cover_texts(sizes):
    text, start, size = language_id.cut(np.array(sizes))
    spans = [(a, a + n) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]][: len(spans)] and sum(size) == sum(sizes)
    assert all(0 < n <= language_id.WIDTH for n in size) and np.bincount(text, size, len(sizes)).astype(int).tolist() == sizes


def test_probabilities_do_not_depend_on_the_batch():
    r = random.Random(2)
    net = language_id.Network(3)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 5, 191, 192, 193, 1000, 30_000)]
    together = net.probabilities(texts)
    for k, t in enumerate(texts):
        assert np.allclose(net.probabilities([t])[0], together[k], atol=1e-5)
    assert np.allclose(together.sum(axis=1), [0, *[1] * 7])


LANGUAGES = {"xa": "ba da ga ra sa ", "xb": "mik tik lik pik nik ", "xc": "ßöü äöß üüß öäü ßßä "}


def text_of(r, lang, n):
    return "".join(r.choice(LANGUAGES[lang].split()) + " " for _ in range(n))


def test_languages_are_told_apart(spark):
    """Held-out documents, with nulls, texts without letters, very long ones, repeated numbers, and languages only there."""
    r = random.Random(4)
    rows = [(k, text_of(r, lang, r.randint(1, 60)), lang) for k, lang in enumerate(r.choice(list(LANGUAGES)) for _ in range(600))]
    odd = [(None, text_of(r, "xa", 40), "xb"), (1000, None, "xa"), (1001, "", "xa"), (1002, "12 34 ...", "xb"), (1003, text_of(r, "xc", 20_000), None), (1004, text_of(r, "xb", 30), None), (5, rows[5][1], rows[5][2])]
    held = [k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 4 == 2]
    got = language_id.identify(table(spark, [*rows, *odd, *[(k, text_of(r, "xa", 30), "never") for k in held]], ["lang"])).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) + len(odd) + len(held)
    assert {by[k].lang_pred for k in (1000, 1001, 1002)} == {"und"} and {by[k].score for k in (1000, 1001, 1002)} == {0.0}
    assert by[None].lang_pred == "xa" and by[1003].lang_pred == "xc" and by[1004].lang_pred == "xb" and {by[k].lang_pred for k in held} == {"xa"}
    out = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(by[k].lang_pred == lang for k, lang in out) >= 0.97 * len(out) > 90
    assert all(0 <= x.score <= 1 for x in got)


def test_nothing_to_learn_from(spark):
    rows = [(1, "some words", None), (2, "...", "xa")]
    got = {x.doc_id: tuple(x)[1:] for x in language_id.identify(table(spark, rows[:1], ["lang"])).collect()}
    assert got == {1: ("und", 0.0)}
    assert language_id.identify(table(spark, [], ["lang"])).collect() == []


def test_the_sample_is_bounded(spark, monkeypatch):
    """A language with most rows and repeated rows of one number add no more than SAMPLE texts of PER_TEXT stretches."""
    monkeypatch.setattr(language_id, "SAMPLE", 5)
    rows = [(k, f"text {k} " * 200, "xa") for k in range(300)] + [(7, f"again {k} " * 200, "xa") for k in range(300)] + [(9000, "rare", "xb")]
    found = language_id.sample(table(spark, rows, ["lang"]))
    sizes = collections.Counter(lang for lang, _ in found)
    assert sizes == {"xa": 5 * language_id.PER_TEXT, "xb": 1} and all(len(part) <= language_id.WIDTH for _, part in found)


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("the driver tables are not here")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cur = con.execute(oracle.SQL[name])
    columns = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == collections.Counter(cur.fetchall())


def test_spelling_variants_send_no_words_through_the_driver(spark):
    words = spark.createDataFrame([("lettuces", 30), ("lettucez", 2)], "word string, n bigint")
    for df in (spelling_variants.variants(words), spelling_variants.near_pairs(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
