"""Scalar functions on bases, qualities and names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The alphabet in its default order, and letters with their complements (others stand for themselves).
ALPHABET = "$ACGNT"
COMPLEMENTS = ("ACGTacgt", "TGCATGCA")
BASES = "ACGT"
RANKS = {"superkingdom": 0, "phylum": 1, "class": 2, "order": 3, "family": 4, "genus": 5, "species": 6, "subspecies": 7, "strain": 7, "subsubspecies": 8}
UNRANKED = 100


def reverse_complement(bases: Column) -> Column:
    return F.translate(F.reverse(bases), *COMPLEMENTS)


def to_length(x: Column, n: int) -> Column:
    """Cut at the end, or padded with N at the start."""
    return F.lpad(F.substring(x, 1, n), n, "N")


def padding_before(bases: Column) -> Column:
    """How many N stand first; one less than all in a read of N only, which keeps its first letter."""
    n = F.length(bases) - F.length(F.regexp_replace(bases, "^N+", ""))
    return F.when(n == F.length(bases), F.lit(0)).otherwise(n)


def unpadded_length(bases: Column) -> Column:
    return F.greatest(F.lit(1), F.length(F.regexp_replace(bases, "^N+|N+$", "")))


def without_padding(x: Column, bases: Column) -> Column:
    """The part of x (bases or qualities) where bases are neither leading nor trailing N."""
    return x.substr(padding_before(bases) + 1, unpadded_length(bases))


def cleaned(x: Column) -> Column:
    """Upper case, N for what is no base."""
    return F.regexp_replace(F.upper(x), "[^ACGNT]", "N")


def packed(base: Column, qual: Column) -> Column:
    """A base call as one byte: the base in two bits, its quality above; N is zero."""
    code = F.call_function("instr", F.lit(BASES), base) - 1
    return F.when(base == "N", F.lit(0)).otherwise(code.bitwiseOR(F.shiftleft(F.ascii(qual) - 33, 2))).cast("int")


def unpacked_base(byte: Column) -> Column:
    return F.when(F.shiftright(byte, 2) == 0, "N").otherwise(F.substring(F.lit(BASES), byte.bitwiseAND(3) + 1, 1))


def unpacked_quality(byte: Column) -> Column:
    return F.chr((F.shiftright(byte, 2) + 33).cast("bigint"))


def organism(header: Column) -> Column:
    """The organism's name from the fifth field of a sequence header."""
    name = F.get(F.split(header, r"\|"), F.lit(4))
    for end in (",", " complete", " main", " chromosome", " genome"):
        name = F.substring_index(name, end, 1)
    at = F.instr(name, " strain ")
    # Seven of the eight letters go, so one space stays; a space in front goes as well.
    name = F.when(at > 0, F.concat(name.substr(F.lit(1), at - 1), name.substr(at + 7, F.length(name)))).otherwise(name)
    return F.regexp_replace(name, "^ ", "")


def rank_level(rank: Column) -> Column:
    pairs = [F.lit(x) for kv in RANKS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), rank), F.lit(UNRANKED))


def weight(tag: Column, length: Column, least: int, most: int) -> Column:
    """How many word lengths an interval stands for."""
    return F.greatest(F.when(tag.contains("DIFF"), length - least + 1).otherwise(F.lit(most - least + 1)), F.lit(1))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix, by binary search over substrings; most: no string is longer."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    fits = lambda n: (F.least(F.length(a), F.length(b)) >= n) & (a.substr(F.lit(1), n) == b.substr(F.lit(1), n))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: F.when(fits(acc + s), acc + s).otherwise(acc))


@F.pandas_udf(DoubleType())
def log_binomial(n: pd.Series, k: pd.Series) -> pd.Series:
    """The logarithm of the number of ways to choose k of n; pairs that repeat are counted once a batch."""
    pairs = pd.DataFrame({"n": n, "k": k})
    few = pairs.drop_duplicates()
    ways = [math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) if 0 < b < a else 0.0 if a == a and b == b else math.nan for a, b in few.itertuples(index=False)]
    return pairs.merge(few.assign(ways=pd.Series(ways, few.index, float)), how="left", on=["n", "k"])["ways"]
