"""Applying corrections, and moving counts to leaves, against plain loops."""

import random

import pytest

from strandlake.operators import correct, sums, taxa


def plain_start(x, y):
    """The whole table of a local alignment, and the way back from the last cell but one: where it leaves the table."""
    best, way = {}, {}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if not i or not j:
                best[i, j] = 0
                continue
            pair = best[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1)
            choices = [(0, (i - 1, j - 1)), (best[i - 1, j] - 1, (i - 1, j)), (best[i, j - 1] - 1, (i, j - 1)), (pair, (i - 1, j - 1))]
            best[i, j] = max(c for c, _ in choices)
            way[i, j] = next(w for c, w in choices if c == best[i, j])
    at = len(x) - 1, len(y) - 1
    while at in way:
        at = way[at]
    return at


def test_alignments_of_random_pairs():
    r = random.Random(1)
    pairs = [("".join(r.choice("ACG") for _ in range(r.randint(1, 12))), "".join(r.choice("ACG") for _ in range(r.randint(1, 17)))) for _ in range(1500)]
    x, y = correct.alignment_starts([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [plain_start(a, b) for a, b in pairs]


def fixed_reads(count):
    """Reads with up to four fixes each, of both strands, whose witnesses often stand elsewhere too."""
    r = random.Random(count)
    reads, fixes = [], []
    for k in range(count):
        read = "".join(r.choice("ACGT" if k % 3 else "AC") for _ in range(40))
        mine = [(r.randrange(12, 28), r.randrange(12), "".join(r.choice("ACGT") for _ in range(r.randint(1, 20))), r.randint(0, 1), r.randint(3, 10)) for _ in range(r.randint(0, 4))]
        reads.append(read)
        fixes.append(sorted(mine))
    return reads, fixes


def place(read, out, fix, first):
    """Where a fix's error stands in what the read has become."""
    p, _, _, turned, n = fix
    if first:
        return p
    at = out.find(read[p - n : p] if turned else read[p + 1 : p + 1 + n])
    return None if at < 0 else at + n if turned else at - 1


def plain_overlay(read, fixes, quality, least, trim):
    text, marks = read, "I" * len(read)
    for k, fix in enumerate(sorted(fixes, key=lambda f: (-f[4], f))):
        error = place(read, text, fix, not k)
        if error is None or fix[4] < least:
            continue
        size = len(fix[2])
        start = error if fix[3] else error + 1 - size
        text, marks = (t[: max(0, start)] + x + t[max(0, start + size) :] for t, x in ((text, fix[2]), (marks, quality * size)))
        if trim:
            text, marks = (t[max(0, -start) :][: len(read)] for t in (text, marks))
    return text, marks


@pytest.mark.parametrize(("least", "trim"), [(0, False), (5, False), (0, True), (6, True)])
def test_overlays(spark, least, trim):
    reads, fixes = fixed_reads(600)
    r = spark.createDataFrame([(i, x, "I" * len(x)) for i, x in enumerate(reads)], "seq_id bigint, bases string, quals string")
    f = spark.createDataFrame([(i, *fix) for i, mine in enumerate(fixes) for fix in mine], "seq_id bigint, position int, corrector_start int, corrector string, reverse_strand int, longest_witness int")
    got = {x.seq_id: (x.bases, x.quals) for x in correct.applied(r, f, "no-indels", "?", least, trim).collect()}
    assert got == {i: plain_overlay(x, mine, "?", least, trim) for i, (x, mine) in enumerate(zip(reads, fixes, strict=True))}


def test_realigned_reads(spark):
    reads, fixes = fixed_reads(500)
    r = spark.createDataFrame([(i, x, None) for i, x in enumerate(reads)], "seq_id bigint, bases string, quals string")
    f = spark.createDataFrame([(i, *fix) for i, mine in enumerate(fixes) for fix in mine], "seq_id bigint, position int, corrector_start int, corrector string, reverse_strand int, longest_witness int")
    want = []
    for read, mine in zip(reads, fixes, strict=True):
        out = read
        for k, fix in enumerate(mine):
            error = place(read, out, fix, not k)
            if error is None:
                continue
            c = fix[2]
            if fix[3]:
                used = len(out) - error - plain_start(c[::-1], out[error:][::-1])[1]
                out = out[:error] + c + out[error + used :]
            else:
                used = error + 1 - plain_start(c, out[: error + 1])[1]
                out = out[: max(0, error + 1 - used)] + c + out[error + 1 :]
        want.append(out)
    got = {x.seq_id: x.bases for x in correct.applied(r, f, "smith-waterman").collect()}
    assert [got[i] for i in range(len(reads))] == want


def test_records_of_corrected_reads(spark):
    r = spark.createDataFrame([(0, "ACGT", None), (1, "GG", None)], "seq_id bigint, bases string, quals string")
    f = spark.createDataFrame([(0, 2, 1, "TT", 0, 3)], "seq_id bigint, position int, corrector_start int, corrector string, reverse_strand int, longest_witness int")
    assert {x.record for x in correct.records(correct.applied(r, f)).collect()} == {">0\nATTT", ">1\nGG"}


def in_turn(counts, database):
    n = dict(counts)
    for t in sorted(n):
        own = database.get((t, t), 0)
        share = n[t] / own if own else 0
        for (leaf, other), db in sorted(database.items()):
            if own and leaf == t and other != t and other in n:
                move = min(int(db * share), n[other])
                n[other] -= move
                n[t] += move
    return n


@pytest.mark.parametrize("seed", range(6))
def test_counts_moved_to_leaves(spark, seed, monkeypatch):
    """Taxa that stand above others and are leaves as well, in any order of numbers; seed 0 has true leaves only."""
    monkeypatch.setattr(sums, "STRIDE", 2)
    r = random.Random(seed)
    counts = {t: r.randint(0, 200) for t in range(20)}
    database = {}
    for t in range(20):
        if seed or t >= 5:
            database[t, t] = r.choice([0, 3, 10, 40])
        for other in r.sample(range(5 if not seed else 20), 3):
            if other != t:
                database[t, other] = r.randint(0, 30)
    database[3, 99] = 5  # counts have no such taxon
    got = taxa.moved_to_leaves(spark.createDataFrame(list(counts.items()), "tax_id bigint, n bigint"), spark.createDataFrame([(t, o, d) for (t, o), d in database.items()], "tax_id bigint, other bigint, db bigint"))
    assert {x.tax_id: x.n for x in got.collect()} == in_turn(counts, database)
