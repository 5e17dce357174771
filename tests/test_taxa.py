import pandas as pd

from strandlake.operators import taxa

#: file 0 and 1 share two ranks, file 2 lacks one, file 3 is unknown at the top.
PATHS = {0: (10, 20, 30), 1: (10, 20, 31), 2: (10, 0, 32), 3: (0, 21, 33)}


def paths(spark):
    return spark.createDataFrame([(f, k, t) for f, ts in PATHS.items() for k, t in enumerate(ts)], "file_num bigint, level int, tax_id bigint")


def files(spark, **sets):
    return spark.createDataFrame([(int(i[1:]), f) for i, fs in sets.items() for f in fs], "interval bigint, file_num bigint")


def test_lowest_common(spark):
    got = dict(map(tuple, taxa.lowest_common(files(spark, i1=[0], i2=[0, 1], i3=[0, 2], i4=[3], i5=[0, 1, 3]), paths(spark)).collect()))
    assert got == {1: 30, 2: 20, 3: 10, 4: taxa.ROOT, 5: 20}


def test_shared_taxa_stop_at_the_first_difference(spark):
    one = spark.createDataFrame([(0, 0, 1), (0, 1, 5), (0, 2, 9), (1, 0, 1), (1, 1, 6), (1, 2, 9)], "file_num bigint, level int, tax_id bigint")
    got = sorted(map(tuple, taxa.shared_taxa(files(spark, i1=[0], i2=[0, 1]), one).collect()))
    assert got == [(1, 1, 5), (1, 2, 9), (2, 0, 1)]


def test_filled_and_parents(spark):
    assert (2, 1, 10) in set(map(tuple, taxa.filled(paths(spark)).collect()))
    assert {(32, 2, 10), (30, 2, 20), (33, 2, 21), (21, 1, 0)} <= set(map(tuple, taxa.parents(paths(spark)).collect()))


def test_first_file_stays(spark):
    hits = spark.createDataFrame([(1, 0, 5), (1, 1, 2), (1, 2, 9)], "interval bigint, file_num bigint, position bigint")
    known = spark.createDataFrame([(0, 2, 7), (1, 2, -1), (2, 2, -1)], "file_num bigint, level int, tax_id bigint")
    assert sorted(r.file_num for r in taxa.distinct_files(hits, known).collect()) == [0, 1]


def tree(spark, depth=70):
    return spark.createDataFrame([(k, max(k - 1, 0), "no rank") for k in range(depth)], "tax_id bigint, parent_id bigint, rank string")


def test_roll_up(spark):
    counts = spark.createDataFrame([(5, 3), (2, 1)], "tax_id bigint, n bigint")
    got = {r.tax_id: (r.n, r.with_children) for r in taxa.rolled_up(counts, tree(spark, 8)).collect()}
    assert got == {0: (0, 4), 1: (0, 4), 2: (1, 4), 3: (0, 3), 4: (0, 3), 5: (3, 3)}


def test_moves_are_seen_by_later_ones(spark):
    counts = pd.DataFrame({"tax_id": [1, 2, 3], "n": [100, 10, 20]})
    database = pd.DataFrame({"tax_id": [2, 2, 3, 3], "other": [2, 1, 3, 1], "db": [5, 20, 10, 50]})
    got = {x.tax_id: x.n for x in taxa.moved_to_leaves(spark.createDataFrame(counts), spark.createDataFrame(database)).collect()}
    assert got == {1: 0, 2: 50, 3: 80}


def test_krona(spark, tmp_path):
    """The written page is well formed, and nested as the tree is."""
    from xml.etree import ElementTree

    counts = spark.createDataFrame([(3, 2), (4, 3), (2, 1)], "tax_id bigint, n bigint")
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "genus"), (3, 2, "species"), (4, 1, "species"), (5, 1, "species")], "tax_id bigint, parent_id bigint, rank string")
    names = spark.createDataFrame([(2, 'a "b" & <c>'), (3, "x"), (4, "y")], "tax_id bigint, name string")
    taxa.write_krona(taxa.krona(taxa.tree_rows(taxa.rolled_up(counts, nodes), nodes), names, nodes), str(tmp_path / "tree"))
    page = ElementTree.fromstring("".join(p.read_text() for p in sorted((tmp_path / "tree").glob("part-*"))))
    read = lambda e: (e.get("name"), int(e.find("magnitude/val").text), getattr(e.find("rank/val"), "text", None), int(e.find("taxid/val").text), [read(x) for x in e.findall("node")])
    assert [read(x) for x in page.find("body/div/krona").findall("node")] == [("1", 6, None, 1, [('a "b" & <c>', 3, "genus", 2, [("x", 2, "species", 3, [])]), ("y", 3, "species", 4, [])])]


def test_hits_are_dealt_by_rows_and_no_sets_are_held(spark, monkeypatch):
    """A task takes so many hits however well they compress, and taxa that agree are found without sets of them."""
    import random

    pick = random.Random(4)
    tree = {f: [pick.choice([-1, 7, 8]), 10 + f % 2, 20 + f] for f in range(6)}
    levels = spark.createDataFrame([(f, k, t) for f, ts in tree.items() for k, t in enumerate(ts)], "file_num bigint, level int, tax_id bigint")
    rows = [(k % 90, pick.randrange(8), k) for k in range(300)]
    monkeypatch.setattr(taxa, "PART", 50)
    found = taxa.distinct_files(spark.createDataFrame(rows, "interval bigint, file_num bigint, position bigint"), levels)
    assert "hashpartitioning(interval#" in (text := found._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in text
    first = {i: f for i, f, _ in reversed(rows)}
    held = {(i, f) for i, f, _ in rows if f in tree or first[i] == f}
    assert sorted(map(tuple, found.collect())) == sorted(held)
    shared = taxa.shared_taxa(found, levels)
    assert "distinct" not in shared._jdf.queryExecution().executedPlan().toString()
    want = []
    for i in {i for i, _ in held}:
        files = [f for j, f in held if j == i]
        for k in range(3):
            seen = [tree[f][k] for f in files if f in tree]
            if not seen:
                break
            known = set(seen) - {-1}
            if len(files) > 1 and len(known) != 1:
                break
            if len(known) == 1 and (len(files) > 1 or k > 0):
                want.append((i, k, max(seen)))
    assert sorted(map(tuple, shared.collect())) == sorted(want)
