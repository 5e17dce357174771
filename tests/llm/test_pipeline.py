"""The pipeline stage by stage against brute force, and the registered queries, on a small folder of tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandlake.llm import common, queries

ITEM = "an item of the benchmark with enough words in it that nobody would write it again by chance alone on a rainy day"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score"]


def rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = [(k, text(60 + k)) for k in range(120)]
    bad = [(500 + k, " ".join(w.upper() + "!!" for w in text(40 + k).split())) for k in range(80)]
    copies = [(700 + k, good[k][1] + (" more" if k % 2 else "")) for k in range(20)]
    return [*good, *bad, *copies, (800, f"{good[3][1][:200]} {ITEM} {good[4][1][:200]}"), (None, good[50][1] + " no number"), (801, None), (802, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string").select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), F.lit("clash").alias("score"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if i >= 500 and i < 700 else 1, 0) for i, _ in rows() if i is not None and i < 700 and i % 4] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (2, None, None)], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), name)
        steps[name] = docs
        if name != "token_output":
            assert docs.columns == COLUMNS
    got = {k: collections.Counter((r.doc_id, r.text) for r in v.collect()) for k, v in steps.items() if k != "token_output"}

    kept = got["quality_classifier"]
    good = [x for x in rows() if x[0] is None or x[0] < 500 or x[0] in range(700, 801)]
    assert sum(x in kept for x in good) >= 0.95 * len(good) and sum(500 <= (i or 0) < 700 for i, _ in kept) <= 4

    sets = [(x, shingles(x[1])) for x in kept]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = collections.Counter()
    for g in set(group):
        members = [sets[k][0] for k in range(len(sets)) if group[k] == g]
        want[min(members, key=lambda x: (x[0] is None, x[0] or 0))] += 1
    assert got["near_duplicates"] == want

    assert got["benchmark_decontamination"] == collections.Counter({x: n for x, n in want.items() if ITEM not in (x[1] or "")})
    assert set(got["mixing"]) == set(got["benchmark_decontamination"])

    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.vocabulary())
    own = collections.Counter()
    for (i, t), n in got["mixing"].items():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own[i, len(ids), zlib.crc32(ids.tobytes())] += n
    out = steps["token_output"].orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == own
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()


def test_stages_without_documents(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_queries_run_on_awkward_tables(spark, folder):
    own = queries.queries()
    assert sorted(own) == sorted(n for n in entry.queries() if n.startswith("op"))
    n = len(rows())
    words = [r.word for r in own["op13_spelling_variants"](spark, folder).collect()]  # a row for each word, not each document
    assert len(words) == len(set(words)) > 0 and all(len(w) >= 7 for w in words)
    for name, f in own.items():
        if name.startswith("op13_"):
            continue
        assert f(spark, folder).count() == (2 if name.startswith("op2_") else n), name
    scored = {r.doc_id: r for r in own["op1_quality_classifier"](spark, folder).collect()}
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows() if i is not None)
    assert [f for f in own["op6_mixing"](spark, folder).columns] == ["doc_id", "tokens", "posterior", "rate", "copies"]
