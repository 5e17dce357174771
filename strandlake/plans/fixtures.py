"""Collections derived from the driver tables, in Spark and as DuckDB common table expressions.

Reads are all letters of every document, mapped to four bases and cut into consecutive reads of 100, the last one of a
document shorter. Collections A and B are the reads of even and odd numbers. The searched words are a word of 12 letters
from every read whose number is divisible by 100 (where it is long enough), and one absent word. The taxonomy is region,
nation and supplier; an order is an interval, and its line items are the genomes that it matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators import suffixes as S

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAPPED = ("ACGT" * 7)[: len(UPPER)]
LENGTH = 100
K, N = 8, 2
ABSENT = "ACGTACGTACGT"

_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"))


def once(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame], kept: bool = False) -> DataFrame:
    """A table made once a session and input. kept: it reads stored tables by itself and is not written again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        from ..operators.storage import stored

        _tables[key] = made() if kept else stored(made())
    return _tables[key]


def cut(docs: DataFrame, maps: tuple[bytes, ...], names: list[str]) -> DataFrame:
    """The reads of documents (seq_id, text) without numbers: seq_id (of the document), piece, and the letters by each map."""
    schema = f"seq_id {docs.schema['seq_id'].dataType.simpleString()}, piece int, " + ", ".join(f"{n} string" for n in names)
    return docs.mapInArrow(lambda batches: P.pieces_of(batches, LENGTH, maps, ["seq_id", "piece", *names]), schema)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text")


def ordered(spark: SparkSession, sf_dir: str, maps: tuple[bytes, ...], names: list[str]) -> DataFrame:
    """`cut` of all documents, in the order of document and piece."""
    # Texts are sorted whole and cut where they stand; as many parts as a shuffle has keep later scans of the short table spread.
    parts = texts(spark, sf_dir).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id")
    return cut(parts, maps, names).sortWithinPartitions("seq_id", "piece")


def loose_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bases of all reads, for what needs neither their numbers nor their order: nothing is shuffled or stored."""
    return cut(texts(spark, sf_dir), MAPS[:1], ["bases"]).select("bases")


def ordered_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bases of all reads in the order of their numbers, which are not told; nothing is stored."""
    return ordered(spark, sf_dir, MAPS[:1], ["bases"]).select("bases")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, bases, and quals from the same letters: all letters of each document in consecutive reads of 100, the last
    one shorter, numbered on end by document and piece.

    Documents without a letter give none.
    """

    def made() -> DataFrame:
        rows = S.numbered(ordered(spark, sf_dir, MAPS, ["bases", "quals"]))
        return rows.select(F.col("rank").alias("seq_id"), "bases", "quals")

    return once(spark, sf_dir, "reads", made, kept=True)


#: Qualities of the letters: ! to :, that is 0 to 25.
QUALITIES = "".join(chr(33 + k) for k in range(26))
MAPS = tuple(bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), x.encode())) for x in (MAPPED, QUALITIES))


def read_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = reads(spark, sf_dir)
    return r.filter("seq_id % 2 = 0"), r.filter("seq_id % 2 = 1")


#: What a transform is asked for: its letters alone, or the whole of what stands at its ranks.
TEXT = ("ch", "prev")


def bwt(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The transform of all reads with the columns named (all, and quals, by default); made once a session and input, since its order
    is needed by many queries, and not again where a table with more columns is there."""
    wanted = set(columns or (*S.COLUMNS, "quals"))
    made = [t for (app, d, name), t in _tables.items() if (app, d) == (spark.sparkContext.applicationId, sf_dir) and name.startswith("bwt ") and wanted <= set(t.columns)]
    if made:
        return made[0]
    carried = sorted(wanted - set(S.COLUMNS))
    return once(spark, sf_dir, " ".join(["bwt", *sorted(wanted)]), lambda: S.bwt(reads(spark, sf_dir), *carried, columns=sorted(wanted & set(S.COLUMNS))), kept=True)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "index", lambda: S.rank_index(bwt(spark, sf_dir, *TEXT)))


def piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "piles", lambda: S.smaller(bwt(spark, sf_dir, *TEXT)))


def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "forward_index", lambda: S.forward_index(bwt(spark, sf_dir, *TEXT), LENGTH))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import search

    return once(spark, sf_dir, "seeds", lambda: search.seeds(index(spark, sf_dir), piles(spark, sf_dir)))


def kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = reads(spark, sf_dir).filter("seq_id % 100 = 0").select(F.col("bases").substr((F.col("seq_id") % 80 + 1).cast("int"), F.lit(12)).alias("kmer")).filter("length(kmer) = 12")
    return picked.unionByName(spark.range(1).select(F.lit(ABSENT).alias("kmer")))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ids = F.array((F.col("n_regionkey") + 10).cast("bigint"), (F.col("n_nationkey") + 100).cast("bigint"), (F.col("s_suppkey") + 1000).cast("bigint"))
    return s.select(F.col("s_suppkey").alias("file_num"), F.posexplode(ids).alias("level", "tax_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda t, i, p, r: t.select(i.cast("bigint").alias("tax_id"), p.cast("bigint").alias("parent_id"), F.lit(r).alias("rank"))
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("tax_id"), F.lit(1).cast("bigint").alias("parent_id"), F.lit("no rank").alias("rank"))
    return (
        root.unionByName(node(region, F.col("r_regionkey") + 10, F.lit(1), "superkingdom"))
        .unionByName(node(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "family"))
        .unionByName(node(supplier, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, "species"))
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tax_id and name; the root has none."""
    part = lambda t, i, n: table(spark, sf_dir, t).select((F.col(i[0]) + i[1]).cast("bigint").alias("tax_id"), F.col(n).alias("name"))
    return part("region", ("r_regionkey", 10), "r_name").unionByName(part("nation", ("n_nationkey", 100), "n_name")).unionByName(part("supplier", ("s_suppkey", 1000), "s_name"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("interval"), F.col("l_suppkey").alias("file_num"), F.col("l_linenumber").cast("bigint").alias("position"), F.col("l_quantity").cast("bigint").alias("num_a"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tax_id, n: the items of each supplier, and a tenth as many for each nation."""
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") + 1000).alias("tax_id")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    n = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 100).cast("bigint").alias("tax_id")).agg((F.count("*") * 10).alias("n"))
    return s.unionByName(n)


def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tax_id, other, db: for each supplier its own hits (none for every seventh key) and those on its nation."""
    s = table(spark, sf_dir, "supplier")
    own = s.select((F.col("s_suppkey") + 1000).alias("tax_id"), (F.col("s_suppkey") + 1000).alias("other"), F.when(F.col("s_suppkey") % 7 == 0, 0).otherwise(F.col("s_suppkey") % 50 + 20).cast("bigint").alias("db"))
    up = s.select((F.col("s_suppkey") + 1000).alias("tax_id"), (F.col("s_nationkey") + 100).cast("bigint").alias("other"), (F.col("s_suppkey") % 9).cast("bigint").alias("db"))
    return own.unionByName(up)


CTES = f"""
letters AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents),
cut AS (SELECT seq_id, i, substr(letters, ({LENGTH} * i + 1)::BIGINT, {LENGTH}) AS x FROM (SELECT seq_id, letters, unnest(range(0, (length(letters) + {LENGTH} - 1) // {LENGTH})) AS i FROM letters)),
reads AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq_id, i) - 1 AS seq_id, translate(x, '{UPPER}', '{MAPPED}') AS bases, translate(x, '{UPPER}', '{QUALITIES.replace("'", "''")}') AS quals FROM cut),
reads_a AS (SELECT * FROM reads WHERE seq_id % 2 = 0),
reads_b AS (SELECT * FROM reads WHERE seq_id % 2 = 1),
suf AS (SELECT seq_id, p::INT AS pos, substr(bases, p::INT + 1) AS suffix, CASE WHEN p = 0 THEN '$' ELSE substr(bases, p::INT, 1) END AS ch, CASE WHEN p = 0 THEN NULL ELSE substr(quals, p::INT, 1) END AS quals FROM reads, range(0, {LENGTH + 1}) t(p) WHERE p <= length(bases)),
bwt AS (SELECT *, row_number() OVER (ORDER BY suffix, seq_id) - 1 AS rank, pos0 AS pile_pos FROM (SELECT *, CASE WHEN suffix = '' THEN '$' ELSE substr(suffix, 1, 1) END AS pile, row_number() OVER (PARTITION BY CASE WHEN suffix = '' THEN '$' ELSE substr(suffix, 1, 1) END ORDER BY suffix, seq_id) - 1 AS pos0 FROM suf)),
runs AS (SELECT row_number() OVER (ORDER BY first_rank) - 1 AS run_no, * FROM (SELECT min(rank) AS first_rank, ch, count(*) AS run FROM (SELECT rank, ch, rank - row_number() OVER (PARTITION BY ch ORDER BY rank) AS g FROM bwt) GROUP BY ch, g)),
kmers AS (SELECT substr(bases, (1 + seq_id % 80)::INT, 12) AS kmer FROM reads WHERE seq_id % 100 = 0 AND length(bases) >= seq_id % 80 + 12 UNION ALL SELECT '{ABSENT}'),
paths AS (SELECT s_suppkey AS file_num, 0 AS level, n_regionkey::BIGINT + 10 AS tax_id FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 1, s_nationkey::BIGINT + 100 FROM supplier UNION ALL SELECT s_suppkey, 2, s_suppkey + 1000 FROM supplier),
nodes AS (SELECT 1::BIGINT AS tax_id, 1::BIGINT AS parent_id, 'no rank' AS rank UNION ALL SELECT r_regionkey::BIGINT + 10, 1, 'superkingdom' FROM region UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT + 10, 'family' FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey::BIGINT + 100, 'species' FROM supplier),
hits AS (SELECT l_orderkey AS interval, l_suppkey AS file_num, l_linenumber::BIGINT AS position, l_quantity::BIGINT AS num_a FROM lineitem),
counts AS (SELECT l_suppkey + 1000 AS tax_id, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1 UNION ALL SELECT c_nationkey::BIGINT + 100, count(*) * 10 FROM customer GROUP BY 1),
database AS (SELECT s_suppkey + 1000 AS tax_id, s_suppkey + 1000 AS other, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 50 + 20 END AS db FROM supplier UNION ALL SELECT s_suppkey + 1000, s_nationkey::BIGINT + 100, s_suppkey % 9 FROM supplier)
""".strip()


def sql(body: str, *more: str) -> str:
    """A statement with the expressions above, and `more` of its own, in front."""
    return f"WITH RECURSIVE {', '.join([CTES, *more])} {body}"
