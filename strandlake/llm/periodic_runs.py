"""Periodic runs of words: maximal stretches that repeat with a period, by the method of Kolpakov and Kucherov.

The words of a text are factored from left to right (Lempel-Ziv): a factor is the longest stretch that also starts
earlier, or a word that is new. The suffix automaton of the words gives it, with its first occurrence, in one walk. A run
that ends in a factor begins less than two factors before it, so Main's algorithm finds all runs that touch a factor's
border from four extension tables of that window. All other runs lie inside a factor and are copies of runs inside its
first occurrence, so they are copied.

Every word of a run that holds `times` periods stands in it `times` times at least. Texts are therefore cut first, without
loss, at words that are rarer in their stretch, until no such word is left; most words of a usual text need no automaton.
One text is one task's work: an automaton takes about half a kilobyte for each word of a stretch.

Null and empty texts have no words and no runs. Ties, repeated rows and repeated document numbers are independent of each
other: every row is judged alone. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, TIMES = 24, 3
SPACE = "[\\x20\\x09-\\x0D]+"
Run = tuple[int, int, int]


def automaton(w: Sequence[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton: transitions of each state, and where the first occurrence of its strings ends."""
    to: list[dict[int, int]] = [{}]
    link, size, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        ends.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] != size[p] + 1:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                ends.append(ends[q])
                link.append(link[q])
                link[q] = copy
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return to, ends


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """start, end and first occurrence (its own start where the word is new) of each factor."""
    to, ends = automaton(w)
    out, start, n = [], 0, len(w)
    while start < n:
        state, at, first = 0, start, start
        while at < n and ends[state := to[state][w[at]]] < at:
            first = ends[state] - (at - start)
            at += 1
        at = max(at, start + 1)
        out.append((start, at, first))
        start = at
    return out


def extensions(s: Sequence[int]) -> list[int]:
    """For each place how long what stands there agrees with the beginning of s."""
    n = len(s)
    z = [n] * n if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(w: Sequence[int], low: int, border: int, high: int, times: int) -> Iterator[tuple[int, int, int]]:
    """start, end, period of repeats within low..high that touch the border: as far as they go there, `times` periods or more."""
    x, y = w[low:border], w[border:high]
    m, n = len(x), len(y)
    back = x[::-1]
    ahead, behind = extensions(y), extensions(back)
    ahead_of, behind_of = extensions([*y, -1, *x])[n + 1 :], extensions([*back, -1, *y[::-1]])[m + 1 :]
    for q in range(1, (m + n) // times + 1):
        if q <= n:  # the border against the place q words right of it
            right = ahead[q] if q < n else 0
            left = behind_of[n - q]
            if left == q < m:  # all of those q words agree: what follows is x against itself
                left += behind[q]
            if q + left + right >= times * q:
                yield border - left, border + q + right, q
        if q <= m:  # the place q words left of the border against it
            right = ahead_of[m - q]
            if right == q < n:
                right += ahead[q]
            left = behind[q] if q < m else 0
            if q + left + right >= times * q:
                yield border - q - left, border + right, q


def runs_of(w: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """start, length, period of all maximal runs of at least `least` words and `times` (two or more) periods."""
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[int]] = {}

    def add(a: int, b: int, q: int) -> None:
        if (a, b) not in found:
            starting.setdefault(a, []).append(b)
        found[a, b] = min(q, found.get((a, b), q))

    before = 0
    for a, b, first in [*factors(w), (n, n, n)]:
        size = b - a
        low = max(0, a - 2 * before - size)
        if b - low >= least:
            for s, t, q in touching(w, low, a, b, times):
                if t - s >= least and (s == 0 or w[s - 1] != w[s - 1 + q]) and (t == n or w[t] != w[t - q]):
                    add(s, t, q)
        if first < a and size >= least + 2:
            shift = a - first
            for s in range(first + 1, b - shift):  # copies made here may be copied again where the occurrences overlap
                for t in list(starting.get(s, ())):
                    if t < b - shift:
                        add(s + shift, t + shift, found[s, t])
        before = size
    return sorted((s, t - s, q) for (s, t), q in found.items())


def stretches(w: Sequence[int], least: int, times: int) -> Iterator[tuple[int, int]]:
    """Stretches of `least` words or more in which every word stands `times` times at least: no run leaves them."""
    waiting = [(0, len(w))]
    while waiting:
        a, b = waiting.pop()
        often = Counter(w[a:b])
        cuts = [i for i in range(a, b) if often[w[i]] < times]
        if not cuts:
            if b - a >= least:
                yield a, b
            continue
        start = a
        for c in [*cuts, b]:
            if c - start >= least:
                waiting.append((start, c))
            start = c + 1


def runs(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs of a text's words, by start, then period."""
    numbers: dict[bytes, int] = {}
    w = [numbers.setdefault(x, len(numbers)) for x in words]
    return sorted((a + s, size, q) for a, b in stretches(w, least, times) for s, size, q in runs_of(w[a:b], least, times))


def collapsed(words: Sequence[bytes], found: list[Run]) -> bytes:
    """The words but those that a run holds after its first period, joined by a space."""
    keep = bytearray(b"\x01") * len(words)
    for s, size, q in found:
        keep[s + q : s + size] = bytes(size - q)
    return b" ".join([x for x, k in zip(words, keep, strict=True) if k]) if found else b" ".join(words)


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text that is left."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, left = [], [], []
            for text in batch.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid and len(text.as_buffer()) else []
                here = runs(words, least, times)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                left.append(collapsed(words, here).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.documents(docs).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten, by the hash of doc_id, the words from some place on repeat with a period."""
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, g % F.col("n"))
    rows = rows.withColumn("a", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    turned = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p as int) + 1))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (the first of several) and hashes of all runs and of the text that is left."""
    best = F.expr("if(size(runs) = 0, null, reduce(runs, runs[0], (x, y) -> if(y.length * x.period > x.length * y.period, y, x)))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.withColumn("best", best)
    milli: Column = F.expr("(1000 * best.length) div best.period")
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
