"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A multinomial classifier, trained on a labelled table (doc_id, domain), predicts how far each document belongs to each
domain. Nonnegative rates (expected copies) of the documents are then fitted by projected-gradient least squares, so that
the expected tokens of each domain have the target shares of all tokens. A step needs only one sum for each domain from
the corpus; a document's rate is a function of its posteriors and of the residuals of all steps so far, so no state is
kept between steps and no lineage grows.

The least squares minimise sum_k (share_k(r) - target_k)^2 / natural_k + RIDGE * sum_d tokens_d (r_d - 1)^2 / tokens over
r >= 0 by steps of length 1 in the tokens' metric, where the largest curvature is at most 1 + RIDGE.

Null and empty texts have no tokens and the domains' prior as posteriors. A null domain, or one without a target, isn't
trained on; of several labels for a document the least counts. A target without labelled documents can't be reached: the
others share its weight. Without any labelled document every rate is 1. Repeated rows get equal rates; a null doc_id is
drawn like any other value; an empty table gives an empty result. Columns of docs other than doc_id and text are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Strings whose counts are the classifier's features.
FEATURES = (" the ", " and ", " of ", " to ", " der ", " die ", " und ", " ein", " le ", " les ", " des ", " et ", " el ", " los ", " que ", " y ", "é", "è", "ê", "ç", "ä", "ö", "ü", "ß", "ñ", "ó", "í", "th", "sch", "eau", "ción")
SMOOTHING = 1.0
#: The log-likelihood counts as that of so many feature occurrences at most: memberships stay soft.
EVIDENCE = 2.0
RIDGE = 0.001
STEPS = 25
CLOSE = 1e-4
DRAW = 1 << 20


def counted(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    times = lambda s: ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(s), F.lit("")))) / len(s.encode())).cast("int")
    return docs.select("doc_id", F.regexp_count(t, F.lit(r"\S+")).alias("tokens"), F.array(*map(times, FEATURES)).alias("features"))


def dot(xs: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(xs, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def model(counts: DataFrame, labelled: DataFrame, domains: list[str]) -> dict[str, tuple[float, list[float]]]:
    """Log prior and log feature weights of each domain that has labelled documents: as many rows as domains at most."""
    one = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sums = counts.join(one, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.get("features", F.lit(i)).cast("double")).alias(f"f{i}") for i in range(len(FEATURES))]).collect()
    total = sum(r.n for r in sums)
    out = {}
    for r in sorted(sums, key=lambda r: r.domain):
        own = [r[f"f{i}"] + SMOOTHING for i in range(len(FEATURES))]
        out[r.domain] = math.log(r.n / total), [math.log(x / sum(own)) for x in own]
    return out


def posteriors(counts: DataFrame, fitted: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """doc_id, tokens and posterior, an array in the order of the fitted domains."""
    seen = F.aggregate("features", F.lit(0), lambda a, x: a + x)
    soft = F.least(F.lit(1.0), EVIDENCE / F.greatest(seen, F.lit(1)))
    raw = F.array(*[F.lit(prior) + soft * dot(F.col("features"), w) for prior, w in fitted.values()])
    part = counts.select("doc_id", "tokens", raw.alias("raw")).select("doc_id", "tokens", F.transform("raw", lambda x: F.exp(x - F.array_max("raw"))).alias("odds"))
    return part.select("doc_id", "tokens", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda a, y: a + y)).alias("posterior"))


def rate(posterior: Column, history: list[list[float]], least: float) -> Column:
    """A document's rate after the steps whose scaled residuals by domain are given."""
    if not history:
        return F.lit(1.0)
    pull = F.transform(F.array(*[F.array(*map(F.lit, g)) for g in history]), lambda g: F.aggregate(F.zip_with(posterior, g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(pull, F.lit(1.0), lambda r, x: F.greatest(F.lit(least), r - x - RIDGE * (r - 1.0)))


def fit(members: DataFrame, targets: list[float], least: float) -> list[list[float]]:
    """The scaled residuals of every step; each step sends one row to the driver.

    Where rates are at least 1, the targets are shares of a larger total, the least of which no domain has too much.
    """
    k = len(targets)
    history: list[list[float]] = []
    natural: list[float] = []
    for _ in range(STEPS + 1):
        r = members.select("tokens", "posterior", rate(F.col("posterior"), history, least).alias("rate"))
        row = r.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * F.col("rate") * F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        if not row["all"]:
            return []
        share = [row[f"s{i}"] / row["all"] for i in range(k)]
        if not natural:
            natural = share
            grow = max(1.0, *(s / t for s, t in zip(share, targets, strict=True))) if least >= 1 else 1.0
            targets = [t * grow for t in targets]
        gap = [s - t for s, t in zip(share, targets, strict=True)]
        if max(map(abs, gap)) < CLOSE or len(history) == STEPS:
            break
        history.append([g / max(n, 1e-9) for g, n in zip(gap, natural, strict=True)])
    return history


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0) -> tuple[DataFrame, list[str]]:
    """doc_id, tokens, posterior (in the order of the returned domains), rate and copies, a row for each of docs.

    Rates are `least` or more; with 1 no document goes, and the mixture grows instead. copies is the rate rounded up or down at random by a hash of doc_id, so that its mean is the rate.
    """
    counts = common.stored(counted(docs), "mixing-counts")
    fitted = model(counts, labelled, sorted(k for k, w in targets.items() if w > 0))
    if not fitted:
        return counts.select("doc_id", F.col("tokens").cast("bigint"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies")), []
    whole = sum(targets[d] for d in fitted)
    members = common.stored(posteriors(counts, fitted), "mixing-posteriors")
    history = fit(members, [targets[d] / whole for d in fitted], least)
    r = members.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), "posterior", rate(F.col("posterior"), history, least).alias("rate"))
    return r.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), list(fitted)


def copies(rate: Column, doc_id: Column) -> Column:
    drawn = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(DRAW)) / DRAW
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """docs with each row as often as its copies say."""
    found, _ = rates(docs, labelled, targets, least)
    # One row for each doc_id: rows of equal doc_id may differ in text, and take the mean of their rates.
    often = found.groupBy("doc_id").agg(copies(F.avg("rate"), F.col("doc_id")).alias("copies")).filter("copies > 0")
    rows = common.boxed(docs)
    often = often.withColumnRenamed("doc_id", "id")
    kept = rows.join(often, rows["doc_id"].eqNullSafe(often["id"])).select("doc_id", "text", "box", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return common.unboxed(kept, docs)
