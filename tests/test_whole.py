"""The queries over documents of any length against their SQL, and the loops without SQL against brute force, on small collections."""

import random

import pytest

from strandlake.operators import compare, correct
from strandlake.plans import fixtures as X
from strandlake.plans import queries as plans

#: Short, long, empty and missing texts, one of exactly two reads, and copies.
WORD = random.Random(5)
LONG = "".join(WORD.choice("abcdefgh ijklmn,") for _ in range(420))
TEXTS = ["tiny", "", None, LONG, LONG[:300] + "z" + LONG[301:], "ab" * 100, "x", LONG[50:400], "The end. 123", "q" * 130]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k * 3, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def cut():
    """seq_id and letters of the reads, in plain Python."""
    out = []
    for t in TEXTS:
        x = "".join(c for c in t or "" if c.isascii() and c.isalpha()).upper()
        out += [x[i : i + 100] for i in range(0, len(x), 100)]
    return [(k, x.translate(str.maketrans(X.UPPER, X.MAPPED))) for k, x in enumerate(out)]


def test_reads_hold_every_letter(spark, folder):
    got = sorted((r.seq_id, r.bases) for r in X.reads(spark, folder).collect())
    assert got == cut()
    assert sum(len(b) for _, b in got) == sum(c.isascii() and c.isalpha() for t in TEXTS for c in t or "")
    assert {len(b) for _, b in got} > {1, 4, 100}


def test_transform_of_every_letter(spark, folder):
    rows = sorted((b[p:], i, p, b[p - 1] if p else "$") for i, b in cut() for p in range(len(b) + 1))
    got = sorted((r["rank"], r.seq_id, r.pos, r.ch) for r in plans.QUERIES["bwt_2"](spark, folder).collect())
    assert got == [(k, i, p, c) for k, (_, i, p, c) in enumerate(rows)]


@pytest.mark.parametrize("name", ["snk_7", "src_16"])
def test_ends_need_no_transform(spark, folder, name, monkeypatch):
    def made(*_):
        raise AssertionError("all suffixes are sorted")

    monkeypatch.setattr(X, "bwt", made)
    got = sorted((r.dollar_num, r.seq_id) for r in plans.QUERIES[name](spark, folder).collect())
    assert got == [(k, i) for k, (_, i) in enumerate(sorted((b, i) for i, b in cut()))]


#: The queries that stand on reads and have SQL.
SAME = [n for n in plans.SQL if n.startswith(("scl_", "bwt_", "src_", "snk_", "sea_", "cmp_", "cor_")) and n not in ("scl_16", "scl_17", "scl_18", "scl_22", "src_21", "src_22", "snk_13", "snk_13_krona")]


@pytest.mark.parametrize("name", SAME)
def test_same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    for t in "part supplier nation region lineitem customer".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = plans.QUERIES[name](spark, folder)
    cur = con.execute(plans.SQL[name])
    columns = sorted(c[0] for c in cur.description)
    assert columns == sorted(df.columns)
    flat = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))]) for r in rows)
    want = flat(cur.fetchall(), [c[0] for c in cur.description])
    assert flat(df.collect(), df.columns) == want


def test_padding_takes_nothing(spark, folder):
    assert sorted((r.seq_id, r.bases) for r in plans.QUERIES["scl_4"](spark, folder).collect()) == [(-1, "N"), *cut()]


def test_halves_of_short_reads(spark, folder):
    rows = cut()
    strings = dict((i, b[-40:]) for i, b in rows) | {i + len(rows): b[:-40] for i, b in rows}
    want = sorted((b[p:], i, p) for i, b in strings.items() for p in range(len(b) + 1))
    assert sorted((r["rank"], r.seq_id, r.pos) for r in plans.QUERIES["bwt_6"](spark, folder).collect()) == [(k, i, p) for k, (_, i, p) in enumerate(want)]


def test_genome_of_all_reads(spark, folder):
    g = "".join(b for _, b in cut())
    order = sorted(range(len(g)), key=lambda p: g[p:])
    assert sorted((r["rank"], r.pos, r.ch) for r in plans.QUERIES["bwt_13"](spark, folder).collect()) == [(k, p, g[p - 1] if p else "$") for k, p in enumerate(order)]


ORDER = "$ACGNT"


def counts_of(strings, k):
    """Words of k letters and how often each letter stands before them, in plain Python."""
    out = {}
    for x in strings:
        for p in range(len(x) - k + 1):
            out.setdefault(x[p : p + k], dict.fromkeys(ORDER, 0))[x[p - 1] if p else "$"] += 1
    return out


def brute_splice(a, b, n):
    """Breakpoints (k, word) and words only in A that begin a read, with the splice rule, until no word is left."""
    found, begins, ask, k, none = set(), set(), None, 2, dict.fromkeys(ORDER, 0)
    while ask is None or any(ask):
        ca, cb = counts_of(a, k), counts_of(b, k)
        if ask is not None:
            ca, cb = ({w: c for w, c in x.items() if w in asked} for x, asked in zip((ca, cb), ask, strict=True))
        ask = set(), set()
        for w in ca.keys() | cb.keys():
            x, y = ca.get(w, none), cb.get(w, none)
            both = w in ca and w in cb
            top = lambda u, v: max(u[c] if not v[c] else 0 for c in "ACGNT")
            emit = both and not any(x[c] and y[c] for c in "ACGNT") and top(x, y) >= n and top(y, x) >= n
            if emit:
                found.add((k, w))
            if w not in cb and x["$"]:
                begins.add(w)
            for c in "ACGT":
                if (both and x[c] >= n) or (w not in cb and x[c]):
                    ask[0].add(c + w)
                if (y[c] >= n if emit else x[c] >= n) if both else (w not in ca and y[c]):
                    ask[1].add(c + w)
        k += 1
    return found, begins


def collections_of(seed):
    r = random.Random(seed)
    genome = "".join(r.choice("ACGT") for _ in range(20))
    other = genome[:4] + ("A" if genome[4] != "A" else "C") + genome[5:]
    return [genome[i : i + 14] for i in (0, 2, 4, 6) for _ in range(3)], [other[i : i + 14] for i in (0, 2, 4, 6) for _ in range(3)]


@pytest.fixture
def two(spark, monkeypatch):
    """Two collections of short reads in place of the documents'."""
    a, b = collections_of(3)
    sets = tuple(spark.createDataFrame(list(enumerate(x)), "seq_id bigint, bases string") for x in (a, b))
    monkeypatch.setattr(X, "read_sets", lambda spark, d: sets)
    monkeypatch.setattr(X, "reads", lambda spark, d: sets[0])
    return a, b


def test_splice_goes_on_to_the_last_word(spark, two):
    want, _ = brute_splice(*two, X.N)
    assert max(k for k, _ in want) > 8
    assert {(r.k, r.word) for r in plans.QUERIES["cmp_3_splice"](spark, "").collect()} == want


def test_words_of_one_side_go_to_the_start(spark, two):
    _, begins = brute_splice(*two, X.N)
    want = sorted((w, i) for i, x in enumerate(two[0]) for k in range(2, len(x) + 1) if (w := x[:k]) in begins)
    assert max(len(w) for w, _ in want) > 8
    assert sorted(tuple(r) for r in plans.QUERIES["cmp_12"](spark, "").collect()) == want


def rule(mode, x, y, both, k, n, least, most):
    """Whether a word is a breakpoint, and the letters that A and B go on with, of words in both."""
    rare = sum(y.values()) == 1
    if mode == "tumour-normal":
        need = lambda u: n if k < 12 else max(n, sum(u[c] for c in "ACGT") // 10)
        apart = any((x[c] > need(x) and not y[c]) or (y[c] > need(y) and not x[c]) for c in "ACGT")
        ended = any(u["$"] == sum(u[c] for c in "ACGT") for u in (x, y))
        emit = both and apart and not ended and all(sum(u[c] > 1 for c in "ACGT") < 3 for u in (x, y))
        return emit, {c for c in "ACGT" if x[c] >= need(x) and not (emit and y[c])}, {c for c in "ACGT" if y[c] >= need(y) and not (emit and x[c])}
    if mode == "reference":
        other = {c for c in "ACGNT" if rare and not y[c] and x[c] > n}
        return both and bool(other), {c for c in "ACGT" if (x[c] and y[c]) or c in other}, {c for c in "ACGT" if y[c]}
    goes = {c for c in "ACGNT" if y[c] and x[c] >= n}
    differs = not goes and any(not y[c] and x[c] >= n for c in "ACGNT")
    ends = not goes and any(y[c] and x[c] < n <= x[c] + x["$"] for c in "ACGNT")
    on = set() if rare and k >= least else goes - {"N"}
    return both and k >= least and (differs or ends or k >= most or rare), on, on


@pytest.mark.parametrize("mode", ["tumour-normal", "reference", "metagenomics"])
@pytest.mark.parametrize("n", [1, 2])
def test_modes_go_on_to_the_last_word(spark, two, mode, n):
    a, b = two
    if mode == "reference":
        b = b[::3]
    sets = [spark.createDataFrame(list(enumerate(x)), "seq_id bigint, bases string") for x in (a, b)]
    none, want, ask, k = dict.fromkeys(ORDER, 0), set(), None, 2
    while ask is None or any(ask):
        counts = [{w: c for w, c in counts_of(x, k).items() if ask is None or w in ask[i]} for i, x in enumerate((a, b))]
        ask = set(), set()
        for w in counts[0].keys() & counts[1].keys():
            x, y = (c.get(w, none) for c in counts)
            emit, left, right = rule(mode, x, y, True, k, n, 4, 9)
            want |= {(k, w)} if emit else set()
            ask[0].update(c + w for c in left)
            ask[1].update(c + w for c in right)
        k += 1
    got = compare.extended(*sets, mode, n, 100, least=4, most=9)
    assert {(r.k, r.word) for r in got.collect()} == want
    assert want or n == 2


@pytest.fixture(scope="module")
def spoilt():
    """Reads of one string, of several lengths, with wrong letters here and there."""
    r = random.Random(11)
    genome = "".join(r.choice("ACGT") for _ in range(60))
    out = []
    for _ in range(90):
        i = r.randrange(0, 40)
        x = genome[i : i + r.randrange(8, 24)]
        out.append("".join(r.choice("ACGTN") if r.random() < 0.03 else c for c in x))
    return out


LEAST, SUPPORTED = 5, 4


def test_errors_of_all_witness_lengths(spark, spoilt):
    reads = spark.createDataFrame(list(enumerate(spoilt)), "seq_id bigint, bases string")
    marks, found = {}, {}
    for k in range(LEAST, 25):
        for w, c in counts_of(spoilt, k).items():
            strong = [x for x in "ACGNT" if c[x] >= SUPPORTED]
            if "N" not in w and len(strong) == 1 and any(0 < c[x] < SUPPORTED for x in "ACGNT"):
                marks[w] = strong[0]
        for i, x in enumerate(spoilt):
            for p in range(1, len(x) - k + 1):
                right = marks.get(x[p : p + k])
                if right and x[p - 1] != right:
                    found.setdefault((i, p - 1), []).append((k, right))
    marked = correct.witnesses(reads, LEAST, 100, SUPPORTED, step=4)
    assert {(r.k, r.word, r.correct) for r in marked.select("k", "word", "correct").distinct().collect()} == {(len(w), w, c) for w, c in marks.items()}
    errors = correct.errors(marked)
    assert sorted((r.seq_id, r.position, r.wrong, r.correct, r.shortest_witness, r.longest_witness) for r in errors.collect()) == sorted((i, p, spoilt[i][p], min(v)[1], min(v)[0], max(v)[0]) for (i, p), v in found.items())
    assert max(max(v)[0] for v in found.values()) > LEAST + 5

    def walked(i, p, longest):
        k, right = min(found[i, p])
        word, out = right + spoilt[i][p + 1 : p + 1 + k], right
        while len(out) < longest:
            c = counts_of(spoilt, len(word)).get(word, dict.fromkeys(ORDER, 0))
            letters = [x for x in "ACGNT" if c[x] >= SUPPORTED]
            if not letters:
                break
            word, out = letters[-1] + word, out + letters[-1]
        return out

    for longest in (1, 4, 100):
        got = correct.correctors(errors, marked, reads, SUPPORTED, longest, step=3).collect()
        assert sorted((r.seq_id, r.position, r.corrector) for r in got) == sorted((i, p, walked(i, p, longest)) for i, p in found)
    assert max(len(walked(i, p, 100)) for i, p in found) > 6


def test_reads_lie_in_as_many_files_as_a_shuffle_has_parts(spark, tmp_path):
    """A short table of reads is scanned by more than one task; texts keep their order, with letters of other scripts left out."""
    texts = {k: f"{'ab' * (k % 130)} \u00e9\U0001f600 Z{'q' * k}" for k in range(0, 400, 2)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    reads = X.reads(spark, str(tmp_path))
    assert len(reads.inputFiles()) == 4
    pieces = [x[i : i + 100] for t in texts.values() for x in ["".join(c for c in t if c.isascii() and c.isalpha()).upper()] for i in range(0, len(x), 100)]
    table = lambda to: str.maketrans(X.UPPER, to)
    assert sorted(map(tuple, reads.select("seq_id", "bases", "quals").collect())) == [(k, x.translate(table(X.MAPPED)), x.translate(table(X.QUALITIES))) for k, x in enumerate(pieces)]


def test_long_words_are_followed(spark, monkeypatch):
    """Words nearly as long as reads, past the letters that come along with a place; in the first rounds no place is a row."""
    r = random.Random(7)
    genome = "".join(r.choice("ACGT") for _ in range(100))
    other = genome[:4] + ("A" if genome[4] != "A" else "C") + genome[5:]
    a, b = [genome[i:j] for i, j in ((0, 100), (2, 97), (0, 60)) for _ in range(3)], [other[i:j] for i, j in ((0, 100), (2, 99), (1, 60)) for _ in range(3)]
    sets = [spark.createDataFrame(list(enumerate(x)), "seq_id bigint, bases string") for x in (a, b)]
    sizes, stored = [], compare.stored
    monkeypatch.setattr(compare, "stored", lambda df: sizes.append((out := stored(df)).count()) or out)
    want, begins = brute_splice(a, b, 2)
    assert max(k for k, _ in want) > 80
    assert {(x.k, x.word) for x in compare.extended(*sets, "splice", 2, 100).collect()} == want
    assert max(sizes) < sum(len(x) - 15 for x in a + b) + 1
    only = sorted((w, i) for i, x in enumerate(a) for k in range(2, len(x) + 1) if (w := x[:k]) in begins)
    assert sorted(tuple(x) for x in compare.read_numbers(*sets, "splice", 2, 100).collect()) == only
