"""Build, inversion, search, comparison and correction on small collections."""

import collections
import random

import pyarrow as pa
import pytest

from strandlake.functions.bases import COMPLEMENTS
from strandlake.operators import compare, correct, merge, order, packing, search, storage, suffixes, sums

#: Two reads of 30 letters that differ in one, and how many breakpoints their comparison has.
PAIR = ("AAAGGCGAAAATGCACATAATTATGGCCTG", "AAAGGCGAAAATACACATAATTATGGCCTG")
BREAKPOINTS = 24


def reads(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "seq_id bigint, bases string")


def made(n=40, length=12, seed=1, letters="ACGTN"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(length)) for _ in range(n)]


def plain(strings):
    rows = sorted((s[p:], i, p, s[p - 1] if p else "$") for i, s in enumerate(strings) for p in range(len(s) + 1))
    return [(k, r[3], r[1], r[2]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("strings", [made(), ["ACGT"] * 5, ["A" * 20, "A" * 20, "A" * 19 + "C"], ["ACGT"]])
def test_build_and_invert(spark, strings):
    table = suffixes.bwt(reads(spark, strings))
    got = sorted((r["rank"], r.ch, r.seq_id, r.pos) for r in table.collect())
    assert got == plain(strings)
    back = {r.number: r.bases for r in suffixes.inverted(table.select("rank", "ch"), max(map(len, strings))).collect()}
    assert back == dict(enumerate(strings))


@pytest.mark.parametrize("genome", ["ACGT", "A" * 40, "ACGTTGCA" * 12 + "NNA", made(1, 300, 9, "AC")[0]])
def test_genome(spark, genome):
    letters = spark.createDataFrame(list(enumerate(genome)), "pos bigint, ch string")
    got = sorted((r["rank"], r.pos, r.ch) for r in suffixes.genome_transform(letters).collect())
    order = sorted(range(len(genome)), key=lambda p: genome[p:])
    assert got == [(k, p, genome[p - 1] if p else "$") for k, p in enumerate(order)]


def test_runs_restore_letters(spark):
    table = suffixes.bwt(reads(spark, made()))
    found = suffixes.runs(table)
    assert sorted(map(tuple, suffixes.expanded(found).collect())) == sorted((r["rank"], r.ch) for r in table.collect())
    rows = [r.ch for r in found.orderBy("run_no").collect()]
    assert all(a != b for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_reverse_complements_follow(spark):
    strings = made(5)
    got = dict(map(tuple, suffixes.with_reverse_complements(reads(spark, strings)).collect()))
    assert got == dict(enumerate(strings)) | {5 + k: s[::-1].translate(str.maketrans(*COMPLEMENTS)) for k, s in enumerate(strings)}


def test_search_and_locate(spark):
    strings = made(60, 30, 3, "ACG")
    words = ["ACG", "CC", "GGGGGGGGG", "ACG", strings[3][4:20]]
    kmers = spark.createDataFrame([(w,) for w in words], "kmer string")
    table = suffixes.bwt(reads(spark, strings))
    found = search.intervals(suffixes.rank_index(table, 8), suffixes.smaller(table), kmers, 8)
    places = lambda w: [(i, p) for i, s in enumerate(strings) for p in range(len(s) - len(w) + 1) if s.startswith(w, p)]
    assert sorted((r.kmer, r["count"]) for r in found.collect()) == sorted((w, len(places(w))) for w in words)
    assert {(r.kmer, r.position) for r in found.collect() if not r["count"]} == {("GGGGGGGGG", 0)}
    assert sorted((r.kmer, r.seq_id, r.pos) for r in search.located(table, found).collect()) == sorted((w, i, p) for w in set(words) for i, p in places(w))
    ordered = [r.kmer for r in search.in_search_order(found).collect()]
    assert ordered == sorted(words, key=lambda w: w[::-1])


def both_strands(spark, s):
    return reads(spark, [s, s[::-1].translate(str.maketrans(*COMPLEMENTS))])


def test_splice_breakpoints(spark):
    found = compare.extended(both_strands(spark, PAIR[0]), both_strands(spark, PAIR[1]), "splice", 1, 30)
    assert found.count() == BREAKPOINTS


ROW = "word string, " + ", ".join(f"{s}_{n} bigint" for s in "ab" for n in ("end", "a", "c", "g", "n", "t"))


@pytest.mark.parametrize(
    ("mode", "a", "b", "k", "emit", "left", "right"),
    [
        ("splice", (0, 3, 0, 0, 0, 0), (0, 0, 3, 0, 0, 0), 5, True, "A", "C"),
        ("splice", (0, 3, 1, 0, 0, 0), (0, 0, 3, 0, 0, 0), 5, False, "A", "A"),
        ("splice", (0, 1, 2, 0, 9, 0), (0, 0, 0, 0, 0, 0), 5, False, "AC", ""),
        ("tumour-normal", (0, 5, 0, 0, 0, 0), (0, 0, 5, 0, 0, 0), 5, True, "A", "C"),
        ("tumour-normal", (5, 5, 0, 0, 0, 0), (0, 0, 5, 0, 0, 0), 5, False, "A", "C"),
        ("tumour-normal", (0, 5, 2, 2, 0, 0), (0, 0, 5, 0, 0, 0), 5, False, "ACG", "C"),
        ("tumour-normal", (0, 30, 2, 0, 0, 0), (0, 9, 0, 0, 0, 0), 12, False, "A", "A"),
        ("reference", (0, 3, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), 5, True, "A", "C"),
        ("reference", (0, 2, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), 5, False, "", "C"),
        ("reference", (0, 3, 0, 0, 0, 0), (0, 0, 2, 0, 0, 0), 5, False, "", "C"),
        ("reference", (0, 3, 1, 0, 0, 0), (0, 0, 0, 0, 0, 0), 5, False, "A", ""),
        ("metagenomics", (0, 3, 0, 0, 0, 0), (0, 0, 2, 0, 0, 0), 60, True, "", ""),
        ("metagenomics", (0, 3, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0), 60, False, "A", "A"),
        ("metagenomics", (0, 3, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0), 100, True, "A", "A"),
        ("metagenomics", (0, 3, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), 60, True, "", ""),
        ("metagenomics", (0, 3, 0, 0, 0, 0), (0, 0, 2, 0, 0, 0), 40, False, "", ""),
    ],
)
def test_rules(spark, mode, a, b, k, emit, left, right):
    df = spark.createDataFrame([("W" * 3, *a, *b)], ROW)
    rows = compare.joined(df.select("word", *[c for c in df.columns if c.startswith("a_")]), df.select("word", *[c for c in df.columns if c.startswith("b_")]))
    e, go_a, go_b = compare.MODES[mode](n=2, k=k)
    r = rows.select(e.alias("e"), *[x[c].alias(s + c) for s, x in (("a", go_a), ("b", go_b)) for c in "ACGT"]).first()
    assert (r.e, "".join(c for c in "ACGT" if r["a" + c]), "".join(c for c in "ACGT" if r["b" + c])) == (emit, left, right)


def test_subset_of_suffixes(spark):
    a, b = reads(spark, made(20, 15, 5, "ACGT")), reads(spark, made(20, 15, 6, "ACGT"))
    whole = {tuple(r) for r in compare.extended(a, b, "splice", 1, 5).collect() if r.word.endswith("CA") or r.k < 2}
    assert {tuple(r) for r in compare.extended(a, b, "splice", 1, 5, subset="CA").collect()} == whole


def test_known_intervals_are_skipped(spark):
    a, b = reads(spark, ["ACGTACGTAA", "ACGTTCGTAC"]), reads(spark, ["ACGTACGTCA", "GGGTTCGTAC"])
    rows2, rows3 = compare.compared(a, b, 2), compare.compared(a, b, 3)
    stems = {r.word: r for r in rows2.collect()}
    same = lambda r, s: (not r.num_a or r.num_a == s.num_a) and (not r.num_b or r.num_b == s.num_b)
    want = {r.word for r in rows3.collect() if not (r.word[:2] in stems and same(r, stems[r.word[:2]]))}
    assert {r.word for r in compare.unknown(rows3, rows2).collect()} == want
    whole = {(r.k, r.word) for r in compare.extended(a, b, "splice", 1, 6).collect()}
    assert {(r.k, r.word) for r in compare.extended(a, b, "splice", 1, 6, skip_known=True).collect()} <= whole


def test_errors_are_found_and_mended(spark):
    genome = "".join(random.Random(8).choice("ACGT") for _ in range(200))
    strings = [genome[k : k + 40] for k in range(0, 160, 2)]
    bad = list(strings[30])
    bad[10] = "A" if bad[10] != "A" else "C"
    wrong = "".join(bad)
    strings[30] = wrong
    r = reads(spark, strings)
    marked = correct.witnesses(r, 8, 10, 3)
    found = correct.errors(marked)
    assert {(x.seq_id, x.position, x.correct) for x in found.collect()} == {(30, 10, genome[70])}
    fixes = correct.mapped_back(correct.correctors(found, marked, r, 3, 4), 1000, 40)
    row = fixes.first().asDict()
    assert row["corrector"] == genome[67:71] and row["corrector_start"] == 7
    mended = {x.seq_id: x.bases for x in correct.applied(r.selectExpr("*", "repeat('I', 40) as quals"), fixes).collect()}
    assert mended[30] == genome[60:100] and mended[3] == strings[3]
    assert correct.realigned([wrong], [[row]]) == [genome[60:100]]


def test_expectations():
    e = correct.Expectations(reads=10_000, length=30, genome=10_000, rate=0.01)
    assert e.destructible(5) > e.destructible(13) > e.destructible(25) >= 0
    assert 1 <= e.specific_length() <= 30 and e.support(14) >= 3
    assert abs(correct.log_binomial(10, 3) - 4.787491742782046) < 1e-9


@pytest.mark.parametrize("letters", ["ACGNT", "AC", "A"])
def test_order_without_text(spark, letters):
    """Long reads of few letters with copies and shared ends: ties go on for many rounds, up to whole reads."""
    r = random.Random(len(letters))
    strings = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 23, 24, 47, 48, 49, 120, 400]))) for _ in range(25)]
    strings += [strings[k][j:] for k, j in ((3, 0), (5, 7), (8, 50))] + ["T" + strings[8], strings[8] + "A", "", "A" * 300]
    want = sorted((s[p:], i, p) for i, s in enumerate(strings) for p in range(len(s) + 1))
    quals = [s.translate(str.maketrans("ACGNT", "IJKLM")) for s in strings]
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(zip(strings, quals, strict=True))], "seq_id bigint, bases string, quals string")
    got = sorted(tuple(x) for x in order.transform(df, "quals").select("rank", "seq_id", "pos", "ch", "pile", "quals").collect())
    assert got == [(k, i, p, strings[i][p - 1] if p else "$", s[:1] or "$", quals[i][p - 1] if p else None) for k, (s, i, p) in enumerate(want)]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(sums, "STRIDE", 3)
    rows = [(g, k * k, (k * 7 + len(g)) % 5) for g in ("a", "bb") for k in range(30)]
    got = {(x.g, x.k): x.before for x in sums.running(spark.createDataFrame(rows, "g string, k bigint, v bigint"), "g", "k", "v").collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}


def test_merged_transforms_and_forward_walk(spark):
    """Interleaving and the walk to a read's end against a plain sort, with copies, empty and missing reads."""
    r = random.Random(14)
    texts = {k: "".join(r.choice("ACGNT") for _ in range(r.choice((0, 1, 5, 12)))) for k in range(24)}
    texts |= {24: texts[3] + "A", 25: texts[3] + "A", 26: "AAAAAAAAAAAA", 27: "AAAAAAAAAAAA", 28: "AAAAAA"}
    reads = spark.createDataFrame([*texts.items(), (40, None)], "seq_id bigint, bases string")
    plain = sorted((t[p:], k, p, t[p - 1] if p else "$") for k, t in texts.items() for p in range(len(t) + 1))
    for parts in ("seq_id % 2 = 0", "seq_id < 0"):
        a, b = reads.filter(parts), reads.filter(f"not ({parts})")
        got = merge.merged(a, suffixes.bwt(a), suffixes.bwt(b), 13).orderBy("rank").collect()
        assert [(x.rank, x.seq_id, x.pos, x.ch) for x in got] == [(k, *row[1:]) for k, row in enumerate(plain)]
    whole = suffixes.bwt(reads)
    # Reads are numbered by their place among the ends.
    number = {k: n for n, k in enumerate(sorted(texts))}
    index = suffixes.forward_index(whole, 13)
    assert [tuple(x) for x in index.orderBy("rank").collect()] == [(k, number[row[1]], len(row[0])) for k, row in enumerate(plain)]
    words = spark.createDataFrame([("AA",), ("CG",), ("TTTTTTT",)], "kmer string")
    found = search.intervals(suffixes.rank_index(whole), suffixes.smaller(whole), words)
    places = search.located_forward(index, suffixes.smaller(whole), found).collect()
    want = sorted((w, number[k], len(s)) for s, k, _, _ in plain for w in ("AA", "CG", "TTTTTTT") if s.startswith(w))
    assert sorted((x.kmer, x.number, x.to_end) for x in places) == want


@pytest.mark.parametrize("sap", [False, True])
def test_order_by_packed_keys(spark, sap):
    """Prefixes, letters before and quals of reads of many lengths; no suffix text goes through the sort."""
    r = random.Random(5)
    strings = ["".join(r.choice("ACGNT") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 30, 200]))) for _ in range(60)]
    strings += [strings[7], strings[9], "A" * 50, "A" * 51, "A" * 52, "", "ACGTN" * 30, "T" + "ACGTN" * 30]
    quals = [s.translate(str.maketrans("ACGNT", "IJKLM")) for s in strings]
    rows = [(i, s, q) for i, (s, q) in enumerate(zip(strings, quals, strict=True))]
    df = spark.createDataFrame(rows, "seq_id bigint, bases string, quals string").repartition(3)
    before = lambda s, p: s[p - 1] if p else None
    for longest in (None, 6):
        at = [(s[p:], i, p) for i, s in enumerate(strings) for p in range(len(s) + 1) if longest is None or len(s) - p <= longest]
        at.sort(key=lambda x: (x[0], before(strings[x[1]], x[2]) or "$", x[1]) if sap else x)
        want = []
        for k, (s, i, p) in enumerate(at):
            last = at[k - 1] if k else ("", None, None)
            shared = next((j for j, (x, y) in enumerate(zip(s, last[0])) if x != y), min(len(s), len(last[0])))
            want.append((k, s[:1] or "$", before(strings[i], p) or "$", i, p, len(s), shared, (before(strings[last[1]], last[2]) or "$") if k else None, before(quals[i], p)))
        table = suffixes.bwt(df, "quals", sap=sap, longest=longest)
        got = sorted(tuple(x) for x in table.select("rank", "pile", "ch", "seq_id", "pos", "length", "lcp", "prev", "quals").collect())
        assert got == want
        assert "suffix" not in table.columns


@pytest.mark.parametrize("sap", [False, True])
def test_order_is_made_in_passes(spark, sap):
    """Few suffixes are shuffled at a time, whatever their number; ranks, neighbours and piles go on over the passes."""
    strings = [*made(40, 30, 3), *[""] * 3, "A" * 40, "A" * 41, "AC", "N", *made(3, 30, 4, "AC")]
    df = spark.createDataFrame([(i, s, s) for i, s in enumerate(strings)], "seq_id bigint, bases string, quals string")
    whole, parts = (suffixes.bwt(df, "quals", sap=sap, size=n, most=9) for n in (1 << 20, 50))
    assert len({f.split("/pass=")[1].split("/")[0] for f in parts.inputFiles() if "/pass=" in f}) == 9
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    rows = df.select("bases")
    spans = suffixes.passes(rows, 50, 9)
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and (spans[0][0], spans[-1][1]) == (0, packing.HEADS)


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_ways_are_shuffled_as_lists(monkeypatch, held):
    """Lists give each way of a word once, its words together, and take a few bytes a letter (a row took four numbers)."""
    monkeypatch.setattr(packing, "SORTED", held)
    strings = [*made(300, 100, 6, "ACGT"), *made(40, 100, 6, "AC"), "", "ACGTACG", "ACGTACGT", "N" * 20]
    sides = [k % 3 == 0 for k in range(len(strings))]
    batch = pa.record_batch([pa.array(sides), pa.array(range(len(strings))), pa.array(strings)], ["is_a", "seq_id", "bases"])
    batches = [batch.slice(0, 100), batch.slice(100)]
    digit = {c: k for k, c in enumerate("$ACGNT")}
    want = collections.Counter()
    for s, is_a in zip(strings, sides, strict=True):
        for p in range(len(s) - 7):
            if "N" not in s[p : p + 8]:
                root = sum("ACGT".index(c) * 4 ** (7 - j) for j, c in enumerate(s[p : p + 8]))
                before = ("$" * 8 + s[:p])[: -9 : -1]
                want[root, sum(digit[c] * 6 ** (7 - j) for j, c in enumerate(before)), is_a] += 1
    lists = pa.Table.from_batches(packing.way_lists(iter(batches), 8, 8, None)).sort_by("bucket")
    assert sum(map(len, lists["list"].to_pylist())) <= 9 * sum(map(len, strings))
    rows = pa.Table.from_batches(packing.listed_ways(iter(lists.to_batches(50)), 8)).to_pylist()
    assert len({(r["root"], r["way"]) for r in rows}) == len(rows)
    assert {(r["root"], r["way"], is_a): r[n] for r in rows for n, is_a in (("n_a", True), ("n_b", False)) if r[n]} == want
    roots = [r["root"] for r in rows]
    assert len(set(roots)) == 1 + sum(a != b for a, b in zip(roots[:-1], roots[1:], strict=True))


def test_a_collection_is_compared_with_itself_at_once(spark):
    """Without a second collection the words and counts are those of the collection beside itself."""
    df = reads(spark, [*made(30, 30, 7, "AC"), *made(30, 30, 8, "ACGN")])

    def words(other):
        found = [d.filter(d.kind == compare.BREAKPOINT).select("k", "word", *compare.COUNTS) for d, _ in compare.rounds(df, other, "single", 6, 19, True)]
        return sorted(tuple(r) for d in found for r in d.collect())

    assert words(None) == words(df) and max(r[0] for r in words(None)) > 8


@pytest.mark.parametrize("words, told", [(["ACGT", "CCAA", "TTTT"], True), (["ACGT", "CCAA", "ANGT"], False), (["ACGT", "CC"], False), (["ACGTACGTACGTA", "AAAAAAAAAAAAA"], False)])
def test_tagged_records_are_made_where_reads_stand(spark, monkeypatch, words, told):
    """A row for each place of a word; nothing is shuffled where the filter tells the words."""
    monkeypatch.setattr(packing, "STEP", 500)
    strings = [*made(40, 60, 9, "ACGTN"), *made(20, 60, 10, "AC"), "", "ACGT", "ACGTACGTACGTACGT", "A" * 30]
    df = spark.createDataFrame([(i, f"n{i}", s) for i, s in enumerate(strings)], "seq_id bigint, name string, bases string")
    kmers = spark.createDataFrame([(w,) for w in [*words, words[0]]], "kmer string")
    found = search.tagged(df, kmers)
    at = [(i, w, p) for i, s in enumerate(strings) for w in words for p in range(len(s) - len(w) + 1) if s.startswith(w, p)]
    assert sorted(map(tuple, found.select("seq_id", "name", "bases").collect())) == sorted((i, f"n{i} {w}", strings[i]) for i, w, _ in at)
    assert sorted(map(tuple, search.occurrences(df, kmers).select("seq_id", "kmer", "pos").collect())) == sorted(at)
    assert ("Exchange" not in found._jdf.queryExecution().executedPlan().toString()) == told


def test_only_the_columns_asked_for_are_stored(spark):
    """The letters of a transform take no numbers of reads, and numbers are stored in two parts."""
    df = spark.createDataFrame([(k << 12, s) for k, s in enumerate(made(20, 30, 5))], "seq_id bigint, bases string")
    whole = suffixes.bwt(df)
    stored = lambda table: set(spark.read.parquet(table.inputFiles()[0].rsplit("/pass=", 1)[0]).columns)
    for columns, kept in ((("ch", "prev"), {"ch", "prev"}), (("seq_id", "pos"), {"high_id", "low_id", "pos"}), (("lcp",), {"lcp", "edge"})):
        table = suffixes.bwt(df, columns=columns)
        assert table.columns == ["rank", "pile", "pile_pos", *columns]
        assert stored(table) == kept | {"part", "pass", "pile"}
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, whole.select(table.columns).collect()))


def test_table_is_written_zstd_and_shuffles_go(spark):
    import pyarrow.parquet as pq

    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    file = storage.stored(spark.range(100).repartition(2)).inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
    assert spark.conf.get(clean, None) == before


def test_runs_begin_by_the_letter_before(spark):
    """Where the table says which letter stands a rank before, its rows are not joined with each other."""
    table = spark.createDataFrame([(0, "A", None), (5, "A", "A"), (6, "C", "A")], "rank bigint, ch string, prev string")
    assert sorted(tuple(x) for x in suffixes.runs(table).collect()) == [(0, 0, "A", 6), (1, 6, "C", 1)]


def shuffled(spark, made, of="shuffleWriteRecords"):
    """The rows of a table that is made, and how many rows (or bytes) were shuffled for them."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def records():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(getattr(stages.apply(k), of)() for k in range(stages.size()))

    before = records()
    rows = made().collect()
    return rows, records() - before


def test_letters_are_shuffled_as_text(spark):
    """Index, walk and runs of a transform in order: rows are packed before they are shuffled, and counted right."""
    letters = "".join(random.Random(3).choice("$AACGNT") * random.Random(k).choice([1, 1, 2, 9]) for k in range(9000))
    prev = [None, *letters]
    table = storage.stored(spark.createDataFrame([(k, c, prev[k]) for k, c in enumerate(letters)], "rank bigint, ch string, prev string").coalesce(2))
    rows, moved = shuffled(spark, lambda: suffixes.rank_index(table.drop("prev"), 1000))
    assert moved < len(letters) // 20
    assert "".join(r.letters for r in sorted(rows, key=lambda r: r.block)) == letters
    assert all(r.before_c == letters[: 1000 * r.block].count("C") for r in rows)
    rows, moved = shuffled(spark, lambda: suffixes.lf(table.drop("prev")))
    assert moved < len(letters) // 20
    order = {k: n for n, k in enumerate(sorted(range(len(letters)), key=lambda k: (letters[k], k)))}
    seen = {c: 0 for c in letters}
    for r in sorted(rows, key=lambda r: r["rank"]):
        assert (r.ch, r.occ, r.lf) == (letters[r["rank"]], seen[r.ch], order[r["rank"]])
        seen[r.ch] += 1
    assert len(rows) == len(letters)
    rows, moved = shuffled(spark, lambda: suffixes.runs(table))
    assert moved < len(letters) // 20
    first = [k for k in range(len(letters)) if prev[k] != letters[k]]
    assert sorted(map(tuple, rows)) == [(n, a, letters[a], b - a) for n, (a, b) in enumerate(zip(first, [*first[1:], len(letters)], strict=True))]


def test_runs_over_blocks_without_a_head_and_rows_in_disorder(spark):
    """Runs longer than blocks, and a table whose rows are in no order."""
    letters = "A" * 3 + "C" * 10000 + "G" + "A" * 5000 + "$"
    rows = [(k, c, letters[k - 1] if k else None) for k, c in enumerate(letters)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "rank bigint, ch string, prev string")
    assert sorted(map(tuple, suffixes.runs(table).collect())) == [(0, 0, "A", 3), (1, 3, "C", 10000), (2, 10003, "G", 1), (3, 10004, "A", 5000), (4, 15004, "$", 1)]
    assert "".join(r.letters for r in sorted(suffixes.rank_index(table).collect(), key=lambda r: r.block)) == letters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_arrays(spark, monkeypatch):
    """Words before which letters are counted, over reads of none, few and many letters: no row for each place is made."""
    from collections import Counter

    strings = ["", "A", "ACG", "NACGTN", *made(50, 40, 4), *made(20, 9, 5, "AC")]
    table = reads(spark, strings)
    for k in (1, 2, 3, 8):
        found = compare.contexts(table, k, "a")
        assert "Generate" not in plan(found)
        seen = Counter((s[p : p + k], s[p - 1] if p else "$") for s in strings for p in range(len(s) - k + 1) if "N" not in s[p : p + k])
        want = {w: tuple(seen[w, c] for c in "$ACGNT") for w, _ in seen}
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == want


def test_places_of_words_pass_a_filter(spark):
    """Only places whose word may be searched for are joined; words shorter and longer than the filter's codes are found."""
    strings = ["", "AC", *made(80, 50, 6)]
    words = ["AC", "N", strings[5][3:15], strings[6][1:30], strings[7][:12], "ACGTACGTACGT", "ACGTACGTACGT", ""]
    found = search.occurrences(reads(spark, strings), spark.createDataFrame([(w,) for w in words], "kmer string"))
    assert "Generate" not in plan(found)
    want = [(w, i, p) for w in set(words) if w for i, s in enumerate(strings) for p in range(len(s) - len(w) + 1) if s.startswith(w, p)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert search.occurrences(reads(spark, strings), spark.createDataFrame([], "kmer string")).collect() == []


def test_ways_are_counted_without_a_sum_for_each_row(spark):
    import math

    from strandlake.functions import bases

    rows = [(100, 40), (100, 40), (100, 0), (0, 0), (5, 5), (100000, 31), (None, 3)]
    found = spark.createDataFrame(rows, "n int, k int").select("n", "k", bases.log_binomial("n", "k").alias("w"))
    assert "lambda" not in plan(found)
    for n, k, w in found.collect():
        assert w is None if n is None else abs(w - sum(math.log((n - k + i) / i) for i in range(1, k + 1))) < 1e-6


@pytest.mark.parametrize("name", ["cmp_1", "cmp_2", "cmp_5", "cmp_6", "cmp_10", "cmp_15", "scl_19"])
def test_words_are_counted_without_stored_reads(spark, tmp_path, monkeypatch, name):
    """Reads are counted where they are cut: no numbered reads are written."""
    from strandlake.plans import fixtures, queries

    def made(*_):
        raise AssertionError("reads are stored")

    spark.createDataFrame([(3, "abc dfg ba" * 40), (1, "x" * 101), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fixtures, "reads", made)
    assert queries.QUERIES[name](spark, str(tmp_path)).count()


def test_sides_of_reads_by_their_order(spark):
    """Partitions of even and of odd numbers of reads, and empty ones: the same as with numbers."""
    strings = ["ACG", "", "NACGTN", *made(48, 40, 14), *made(20, 9, 15, "AC")]
    numbered = reads(spark, strings)
    want = sorted(map(tuple, compare.compared(numbered.filter("seq_id % 2 = 0"), numbered.filter("seq_id % 2 = 1"), 3).collect()))
    for n in (1, 3, 7):
        parts = spark.sparkContext.parallelize([(x,) for x in strings], n).toDF("bases string")
        assert sorted(map(tuple, compare.in_turn(parts, 3).collect())) == want
    few = spark.sparkContext.parallelize([("ACG",), ("AGG",), ("ACT",)], 8).toDF("bases string")
    assert {(r.word, r.where) for r in compare.in_turn(few, 3).collect()} == {("ACG", "A"), ("AGG", "B"), ("ACT", "A")}
