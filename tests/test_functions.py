import pytest
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.functions import runs as R

RUNS = [(c, n) for c in "$ACGNT" for n in (1, 3, 4, 5, 16, 17, 58, 59, 63, 64, 928, 929, 58 * 16, 58 * 16 + 1, 10**6)]


def test_reverse_complement(spark):
    rows = spark.createDataFrame([("ACGTN",), ("acgt",), ("",), (None,), ("A$Z",)], "x string").select(B.reverse_complement(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["NACGT", "ACGT", "", None, "Z$T"]


@pytest.mark.parametrize(("bases", "want"), [("NNACNGNN", "ACNG"), ("NNNN", "N"), ("ACG", "ACG"), ("NA", "A")])
def test_padding(spark, bases, want):
    quals = "".join(chr(40 + k) for k in range(len(bases)))
    at = 0 if set(bases) == {"N"} else len(bases) - len(bases.lstrip("N"))
    r = spark.createDataFrame([(bases, quals)], "b string, q string").select(B.without_padding(F.col("b"), F.col("b")), B.without_padding(F.col("q"), F.col("b"))).first()
    assert tuple(r) == (want, quals[at : at + len(want)])


def test_byte_calls(spark):
    r = spark.createDataFrame([("A", "I"), ("T", "#"), ("N", "!"), ("G", "!")], "b string, q string").withColumn("x", B.packed(F.col("b"), F.col("q"))).select("x", B.unpacked_base(F.col("x")), B.unpacked_quality(F.col("x"))).collect()
    assert [tuple(x) for x in r] == [(40 * 4, "A", "I"), (3 + 2 * 4, "T", "#"), (0, "N", "!"), (2, "N", "!")]


def test_version_3_columns_equal_files(spark):
    df = spark.createDataFrame(RUNS, "ch string, run bigint")
    codes = [c for r in df.select(R.v3_codes(F.col("ch"), F.col("run")).alias("x")).collect() for c in r.x]
    data = R.v3_file(RUNS)
    assert list(data[-len(codes) :]) == codes and data.startswith(b"BWT\r\n\x1a")
    assert R.v3_parsed(data) == RUNS
    with pytest.raises(ValueError):
        R.v3_parsed(b"BWT\n" + data)


def test_nibble_columns(spark):
    df = spark.createDataFrame(RUNS, "ch string, run bigint").select("ch", F.explode(R.pieces(F.col("run"), 16)).alias("run"))
    found = R.nibble_parsed(bytes(r[0] for r in df.select(R.nibble_byte(F.col("ch"), F.col("run"))).collect()))
    assert found == [tuple(r) for r in df.collect()] and sum(n for _, n in found) == sum(n for _, n in RUNS)


def test_common_prefix(spark):
    rows = [("ACGT", "ACGA"), ("", "A"), ("ACGT", "ACGT"), ("ACGT", "ACGTACGT"), ("T", "A")]
    got = spark.createDataFrame(rows, "a string, b string").select(B.common_prefix(F.col("a"), F.col("b"), 100)).collect()
    assert [r[0] for r in got] == [3, 0, 4, 4, 0]
