"""Near duplicates by bottom-k sketches from one hash function.

A document's set is that of its distinct word shingles, as 64-bit hashes; its sketch is the SKETCH least of them. Equal
sets are one class, so exact copies cost one row. Inverted lists of the retained values generate overlaps: two sets of
similarity 0.8 share at least NEEDED of SKETCH values but for one case in 3e10 (a binomial tail; sets of fewer than about
100 shingles never fail), so by the pigeonhole principle, in one global order from rare to frequent, they share one of the
rarest SKETCH - NEEDED + 1 values of each, and only those are listed. The union sketch estimates the similarity and
filters, by the same bound; the exact Jaccard similarity of the full sets verifies.

No list is expanded into all its pairs. Lists of at most SMALL classes are. Longer ones are split into bands of set size,
so that classes too different in size never meet, and each band has a hub (the class with the fewest values of its own, as
an original among its edited copies); all bands of one hub are a group. Kin, whose sketches allow a link with the hub, are
compared with it by full sets: a near one is linked. What is left among kin are pairs
with at least one far class. For those only the differences from the hub matter. Write D(x) for the
symmetric difference of x and the hub h, and q(x) = 9 |D(x)| - |x|. Then x and y are linked only if
18 |D(x) & D(y)| >= q(x) + q(y), and h is near x just if q(x) <= |h|; so a link with a far class needs a common difference,
and (pigeonhole again, rare differences first) one among the first of each. These are new inverted lists, which edits made
by chance never fill, however many copies there are; ROUNDS such rounds are made. What is left then (copies whose edits
are copied as well), and strangers to the hub, whose texts share some passages or common words with it, are compared by
their sketches in blocks: far classes and strangers against all of the group, a bounded number of rows and values in a task, each of
which gives a spanning set of links.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Fewer words than a shingle
has are one shingle. Repeated rows are in one class; a null doc_id is a document like any other, whose component is named
by the least non-null doc_id. An empty table gives an empty result. Other columns are ignored or carried.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components

SKETCH, NEEDED = 64, 28
SMALL = 12
ROUNDS = 2
BLOCK = 1024
#: Values of full sets in one side of a block, about: long texts are compared in blocks of fewer rows.
VALUES = 1 << 20
#: Columns of an incidence matrix that are held at once, for values of more than FEW rows.
SLAB, FEW = 2048, 24
THRESHOLD = 80  # of 100
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, which is in lower case already."""
    flat = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inside = ~SPACE[flat]
    change = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    up, down = powers(len(flat))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up)])
    word = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    cut = np.searchsorted(start, first)
    n = len(word)
    joined = np.zeros(n, np.uint64)
    for k in range(min(size, n)):  # with fewer words in all than a shingle has, nothing here is read
        joined[: n - k] = mixed(joined[: n - k] * np.uint64(3) + word[k:] + np.uint64(k))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1].view(np.int64)))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mixed(one * np.uint64(3) + word[k : k + 1] + np.uint64(1000 + b - a))
            out.append(one.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def in_batches(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about `most` bytes of text, as lower-case bytes."""
    texts = [t.encode("utf-8", "surrogatepass").lower() for t in batch.column("text").to_pylist()]
    a = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most or k + 1 == len(texts):
            yield batch.slice(a, k + 1 - a), texts[a : k + 1]
            a, held = k + 1, 0


def sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), sig (128 bits of the whole set) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in in_batches(whole):
                found = shingles(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s[:SKETCH] for s in found], pa.list_(pa.int64()))],
                    ["doc_id", "n", "sig", "sketch"],
                )

    return common.documents(docs).mapInArrow(run, "doc_id bigint, n bigint, sig binary, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sig and the whole set of every class in `wanted` (sig, doc), from the text of one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in in_batches(whole):
                found = shingles(texts, size)
                yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["sig", "own", "hashes"])

    left = common.documents(docs)
    texts = left.join(wanted, left["doc_id"].eqNullSafe(wanted["doc"])).select("sig", "text")
    return texts.mapInArrow(run, "sig binary, own binary, hashes array<bigint>").filter("sig = own").select("sig", "hashes").dropDuplicates(["sig"])


def least_overlap(size: Column, n: Column) -> Column:
    """How many values of a sketch of `size` values, of a set of n, a similar set's sketch has at least.

    The sets differ in a fifth of their union at most, so the other one lacks n / 4 values at most: certain, and more than
    the binomial bound for sets of fewer than 68.
    """
    return F.greatest(F.lit(1), F.floor(size * NEEDED / SKETCH), size - F.floor(n * 100 / THRESHOLD - n)).cast("int")


def memberships(reps: DataFrame) -> DataFrame:
    """The inverted lists: value, sig, n and own (values of the sketch that no other class has)."""
    each = reps.select("sig", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    often = common.stored(each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "frequent-values")
    shared = each.join(often, "value").groupBy("sig").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    own = F.col("s") - F.size("values")
    room = F.col("s") - least_overlap(F.col("s"), F.col("n")) + 1 - own
    return shared.filter(room > 0).select("sig", "n", own.alias("own"), F.explode(F.slice("values", 1, room)).alias("v")).select("v.value", "sig", "n", "own")


def near_sizes(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (x, y) whose union sketch allows the similarity."""
    side = lambda c: reps.select(F.col("sig").alias(c), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    union = F.slice(F.array_sort(F.array_union("sx", "sy")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sx", "sy"), "u"))
    return both.select("x", "y", "sx", "sy", union.alias("u")).filter(shared >= F.greatest(F.lit(1), F.floor(F.size("u") * NEEDED / SKETCH))).select("x", "y")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    side = lambda c: full.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    return both.select("x", "y", shared.alias("i"), (F.size("hx") + F.size("hy") - shared).alias("u")).filter(f"100 * i >= {THRESHOLD} * u").select("x", "y")


def needed(sizes: np.ndarray) -> np.ndarray:
    """`least_overlap` of the sketches of sets of these sizes."""
    sketch = np.minimum(sizes, SKETCH)
    return np.maximum(np.maximum(1, sketch * NEEDED // SKETCH), sketch - (sizes * 100 // THRESHOLD - sizes))


def shared_values(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every value that several rows have, by number."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if not len(row):
        return row, row
    _, where, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = count > 1
    number = (np.cumsum(several) - 1)[where]
    kept = np.flatnonzero(several[where])
    kept = kept[np.argsort(number[kept], kind="stable")]
    return row[kept], number[kept]


def overlaps(lists: list[np.ndarray], ask: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How many values each row in `ask` has in common with each in `target`. Values of few rows are counted pair by pair,
    the others by a product of incidence matrices, in slabs."""
    row, number = shared_values(lists)
    out = np.zeros((len(ask), len(target)), np.float32)
    if not len(row):
        return out
    count = np.bincount(number)
    light = count[number] <= FEW
    asks, targets = np.full(len(lists), -1), np.full(len(lists), -1)
    asks[ask], targets[target] = np.arange(len(ask)), np.arange(len(target))
    r, v, codes = row[light], number[light], []
    for k in range(1, min(FEW, len(r))):
        at = np.flatnonzero(v[k:] == v[:-k])
        if not len(at):
            break
        for x, y in ((r[at], r[at + k]), (r[at + k], r[at])):
            code = asks[x] * len(target) + targets[y]
            codes.append(code[(asks[x] >= 0) & (targets[y] >= 0)])
    if codes:
        out += np.bincount(np.concatenate(codes), minlength=out.size).reshape(out.shape).astype(np.float32)
    heavy = np.flatnonzero(count > FEW)
    r, v = row[~light], np.searchsorted(heavy, number[~light])
    for a in range(0, len(heavy), SLAB):
        lo, hi = np.searchsorted(v, (a, a + SLAB))
        has = np.zeros((len(lists), min(SLAB, len(heavy) - a)), np.float32)
        has[r[lo:hi], v[lo:hi] - a] = 1
        out += has[ask] @ has[target].T
    return out


def pruned(group: pd.DataFrame) -> pd.DataFrame:
    """Without the rows that share too few values with all others together to share enough with any one."""
    while len(group):
        row, _ = shared_values(group["sketch"].to_list())
        enough = np.bincount(row, minlength=len(group)) >= needed(group["n"].to_numpy())
        if enough.all():
            break
        group = group[enough].reset_index(drop=True)
    return group


def asked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that ask, rows that are targets, and which pairs are to be compared: each once, of fitting sizes."""
    ask, target = np.flatnonzero(group["ask"]), np.flatnonzero(group["target"])
    sizes, names, far = group["n"].to_numpy().astype(np.int64), pd.factorize(group["sig"], sort=True)[0], group["far"].to_numpy()
    a, t = ask[:, None], target[None, :]
    # Of two far classes, which both ask, the one of less sig does.
    wanted = (100 * np.minimum(sizes[a], sizes[t]) >= THRESHOLD * np.maximum(sizes[a], sizes[t])) & (names[a] != names[t]) & ~(far[t] & (names[t] < names[a]))
    return ask, target, wanted


def surviving(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block pair whose sketches allow the similarity with another one."""
    group = pruned(group)
    ask, target, wanted = asked(group)
    least = needed(group["n"].to_numpy())
    q, other = np.nonzero(wanted & (overlaps(group["sketch"].to_list(), ask, target) >= np.minimum(least[ask][:, None], least[target][None, :])))
    return group[["g", "i", "j", "sig", "n", "far", "ask", "target"]].iloc[np.unique(np.concatenate([ask[q], target[other]]))]


def compared(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of the links in one block pair, by full sets."""
    group = group.sort_values("sig", ignore_index=True)
    ask, target, wanted = asked(group)
    # Classes that aren't far are linked with each other by way of their hub, or compared elsewhere.
    sets_ = [np.asarray(x) for x in group["hashes"]]
    both = overlaps(sets_, ask, target)
    size = group["n"].to_numpy().astype(np.int64)
    union = size[ask][:, None] + size[target][None, :] - both
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while (p := parent.get(k, k)) != k:
            k = p
        return k

    found = []
    for q, t in zip(*np.nonzero(wanted & (100 * both >= THRESHOLD * union)), strict=True):
        k, other = root(int(ask[q])), root(int(target[t]))
        if k != other:
            found.append((group["sig"][int(ask[q])], group["sig"][int(target[t])]))
            parent[max(k, other)] = min(k, other)
    return pd.DataFrame(found, columns=["x", "y"])


def met(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From lists (value, sig, n, own, index, probe): the pairs of the short ones, and the groups (g, sig) of the long
    ones, a group being all lists of one hub. A pair meets where one is in the index and the other one probes."""
    heads = lists.groupBy("value").agg(F.count("*").alias("m"), F.max("index").alias("i"), F.max("probe").alias("p"), F.min(F.struct("own", "sig")).alias("hub")).filter("i and p and m > 1")
    heads = common.stored(heads.select("value", "m", F.col("hub.sig").alias("g")), "list-heads")
    short = lists.join(heads.filter(f"m <= {SMALL}").select("value"), "value")
    left = short.select("value", F.col("sig").alias("x"), "n", F.col("index").alias("xi"), F.col("probe").alias("xp"))
    right = short.select("value", F.col("sig").alias("y"), F.col("n").alias("m"), F.col("index").alias("yi"), F.col("probe").alias("yp"))
    pairs = left.join(right, "value").filter("x < y and (xi and yp or xp and yi)").filter(near_sizes(F.col("n"), F.col("m"))).select("x", "y").distinct()
    groups = lists.join(heads.filter(f"m > {SMALL}").select("value", "g"), "value").select("g", "sig", "n").distinct()
    return pairs, groups


def differences(groups: DataFrame, full: DataFrame) -> DataFrame:
    """g, h (the hub's size), sig, n, q and the sorted differences d from the hub, for every other class of a group.

    A hub's set is copied once for each BLOCK classes of its group, so that a large group isn't one join key.
    """
    parts = common.stored(groups.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "group-parts")
    hubs = parts.join(full.select(F.col("sig").alias("g"), F.col("hashes").alias("hub")), "g").select("g", "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = groups.filter("g != sig").join(parts, "g").withColumn("part", F.pmod(F.xxhash64("sig"), "parts").cast("int")).join(full, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hub = batch.column("hashes"), batch.column("hub")
            found = [np.setxor1d(own[k].values.to_numpy(), hub[k].values.to_numpy(), assume_unique=True) for k in range(batch.num_rows)]
            n, h = batch.column("n").to_numpy(), np.array([len(x) for x in hub], np.int64)
            q = 9 * np.array([len(d) for d in found], np.int64) - n
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(h), batch.column("sig"), batch.column("n"), pa.array(q), pa.array(found, pa.list_(pa.int64()))], ["g", "h", "sig", "n", "q", "d"])

    rows = members.join(hubs, ["g", "part"]).select("g", "sig", "n", "hashes", "hub")
    return common.small_batches(rows).mapInArrow(run, "g binary, h bigint, sig binary, n bigint, q bigint, d array<bigint>")


def listed(members: DataFrame) -> DataFrame:
    """New lists by difference, in the form of `met`, of the groups' `differences`.

    Of a pair the one of less q is in the index, and the other one, which is far, probes. The common differences are at
    least (q + q') / 18, where q' is a far one's and no less than q. Differences that no other class of the group has
    come first; a class with enough of them isn't listed at all, and only listed differences are probed for.
    """
    # A large group's rows are dealt out evenly before they are expanded.
    even = lambda rows: rows.repartition("g", "sig")
    each = even(members.select("g", "sig", "d")).select("g", "sig", F.explode("d").alias("v"))
    counted = common.stored(each.groupBy("g", "v").agg(F.count("*").alias("df"), F.min("sig").alias("sig")), "counted-differences")
    own = counted.filter("df = 1").groupBy("g", "sig").agg(F.count("*").cast("int").alias("own"))
    known = common.stored(members.join(own, ["g", "sig"], "left").withColumn("own", F.coalesce("own", F.lit(0))), "own-differences")
    first = F.size("d") - F.ceil((F.col("q") + F.greatest("q", F.col("h") + 1)) / 18) + 1 - F.col("own")
    thin = even(known.withColumn("first", first.cast("int")).filter("first > 0")).select("g", "sig", "n", "own", "first", F.explode("d").alias("v"))
    often = counted.filter("df > 1").select("g", "v", "df")
    ranked = thin.join(often, ["g", "v"]).groupBy("g", "sig").agg(*[F.first(c).alias(c) for c in ("n", "own", "first")], F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    index = common.stored(ranked.select("g", "sig", "n", "own", F.explode(F.slice("values", 1, F.col("first"))).alias("x")).select("g", "x.v", "sig", "n", "own"), "index-differences")
    probe = even(known.filter("q > h").join(index.select("g").distinct(), "g", "left_semi")).select("g", "sig", "n", "own", F.explode("d").alias("v")).join(index.select("g", "v").distinct(), ["g", "v"])
    entry = lambda rows, listed_: rows.select(F.xxhash64("g", "v").alias("value"), "sig", "n", "own", F.lit(listed_).alias("index"), F.lit(not listed_).alias("probe"))
    return entry(index, True).unionByName(entry(probe, False))


def checked(pairs: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    return common.stored(verified(common.stored(estimated(pairs, reps), "candidates"), full), "links")


def linked(docs: DataFrame, size: int, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (sig, doc, n) and links (x, y) between classes that span every component."""
    filled = found.filter("n > 0")
    classes = common.stored(filled.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n")), "classes")
    sketches = filled.select("sig", F.col("doc_id").alias("d"), "n", "sketch")
    first = classes.select(F.col("sig").alias("c"), "doc")
    reps = common.stored(sketches.join(first, (F.col("sig") == F.col("c")) & F.col("d").eqNullSafe(F.col("doc"))).select("sig", "n", "sketch").dropDuplicates(["sig"]), "sketches")
    lists = common.stored(memberships(reps), "inverted-lists")
    wide = common.stored(lists.groupBy("value").agg(F.count("*").alias("m")).filter(f"m > {SMALL}").select("value"), "long-lists")
    # A class stands in the band of its size and the next; similar sizes share one. A band's name is a value of its own.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / THRESHOLD)).cast("int")
    banded = lists.join(wide, "value").withColumn("value", F.explode(F.transform(F.array(band, band + 1), lambda b: F.xxhash64("value", b))))
    split = common.stored(lists.join(wide, "value", "left_anti").unionByName(banded).withColumn("index", F.lit(True)).withColumn("probe", F.lit(True)), "bands")

    pairs, groups = met(split)
    some, groups = common.stored(estimated(pairs, reps), "candidates"), common.stored(groups.filter("g != sig"), "groups")
    beside = estimated(groups.select(F.col("sig").alias("x"), F.col("g").alias("y")), reps).select(F.col("y").alias("g"), F.col("x").alias("sig"))
    kin = common.stored(groups.join(beside.withColumn("kin", F.lit(True)), ["g", "sig"], "left").withColumn("kin", F.coalesce("kin", F.lit(False))), "kin")
    ends = some.select(F.col("x").alias("sig")).unionByName(some.select(F.col("y").alias("sig"))).unionByName(kin.filter("kin").select(F.explode(F.array("g", "sig")).alias("sig"))).distinct()
    full = common.stored(full_sets(docs, ends.join(classes, "sig").select("sig", "doc"), size), "full-sets")
    links = [common.stored(verified(some, full), "links")]
    # Strangers to the hub are compared with all of its group in blocks; kin by their differences from it.
    blocks = [kin.select(F.concat("g", F.lit(b"s")).alias("g"), "sig", "n", (~F.col("kin")).alias("far"))]
    groups = kin.filter("kin").select("g", "sig", "n")
    spent = [lists, wide, split, some, kin]
    for again in range(ROUNDS):
        if groups.isEmpty():
            break
        members = common.stored(differences(groups, full), "differences")
        spent.append(members)
        links.append(common.stored(members.filter("q <= h").select(F.col("g").alias("x"), F.col("sig").alias("y")), "links"))
        live = members.join(members.filter("q > h").select("g").distinct(), "g", "left_semi")
        if again + 1 == ROUNDS:
            blocks.append(live.select(F.concat("g", F.lit(b"k")).alias("g"), "sig", "n", (F.col("q") > F.col("h")).alias("far")))
            break
        split = common.stored(listed(live), "difference-lists")
        pairs, groups = met(split)
        links.append(checked(pairs, reps, full))
        groups = common.stored(groups.filter("g != sig"), "groups")
        spent += [split, groups]
    links.append(crossed(docs, functools.reduce(DataFrame.unionByName, blocks), classes, reps, size))
    every = common.stored(functools.reduce(DataFrame.unionByName, links), "all-links")
    common.released(*spent, *links, full, reps)
    return classes, every


def crossed(docs: DataFrame, rows: DataFrame, classes: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """Links with far classes in groups (g, sig, n, far), block by block: far ones against all of their group."""
    far, n = F.col("far").cast("int"), F.col("n")
    parts = lambda rows_, values: F.ceil(F.greatest(rows_ / BLOCK, values / VALUES)).cast("int")
    count = rows.groupBy("g").agg(parts(F.count("*"), F.sum("n")).alias("blocks"), parts(F.sum(far), F.sum(far * n)).alias("asks")).filter("asks > 0")
    dealt = rows.withColumn("hash", F.xxhash64("sig")).join(common.stored(count, "group-blocks"), "g")
    part = lambda n: F.pmod("hash", n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ("sig", "n", "far")
    one = dealt.filter("blocks = 1").select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), *row, F.col("far").alias("ask"), F.lit(True).alias("target"))
    askers = dealt.filter("blocks > 1 and far").select("g", part("asks").alias("i"), every("blocks").alias("j"), *row, F.lit(True).alias("ask"), F.lit(False).alias("target"))
    targets = dealt.filter("blocks > 1").select("g", every("asks").alias("i"), part("blocks").alias("j"), *row, F.lit(False).alias("ask"), F.lit(True).alias("target"))
    keyed = one.unionByName(askers).unionByName(targets)
    kind = "g binary, i int, j int, sig binary, n bigint, far boolean, ask boolean, target boolean"
    kept = common.stored(keyed.join(reps.select("sig", "sketch"), "sig").groupBy("g", "i", "j").applyInPandas(surviving, kind), "surviving")
    full = full_sets(docs, kept.select("sig").distinct().join(classes, "sig").select("sig", "doc"), size)
    return common.stored(kept.join(full, "sig").groupBy("g", "i", "j").applyInPandas(compared, "x binary, y binary"), "links")


def classify(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's document of least doc_id), a row for each of docs."""
    found = common.stored(sets(docs, size), "shingle-sets").select("doc_id", "n", "sig", "sketch")
    classes, links = linked(docs, size, found)
    label = components.labels(links)
    named = classes.join(label, F.col("sig") == F.col("node"), "left").select("sig", "doc", F.coalesce("label", "sig").alias("label"))
    least = common.stored(named.groupBy("label").agg(F.min("doc").alias("component_id")), "component-names")
    names = common.stored(named.join(least, "label").select("sig", "component_id"), "class-names")
    rows = found.select("doc_id", "n", "sig")
    return (
        rows.filter("n > 0").join(names, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def representatives(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the least doc_id; of several such, the least text.

    Copies of whole rows are told apart by number only where a doc_id repeats, so a usual table isn't sorted.
    """
    keep = classify(docs, size).filter("kept").groupBy("doc_id").agg(F.count("*").alias("times")).select(F.col("doc_id").alias("kept_id"), "times")
    boxed = common.boxed(docs)
    held = common.stored(boxed.join(keep, boxed["doc_id"].eqNullSafe(keep["kept_id"])).drop("kept_id"), "representatives")
    once = common.unboxed(held.filter("times = 1"), docs)
    several = held.filter("times > 1")
    if several.isEmpty():
        return once
    first = several.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")))))
    return once.unionByName(common.unboxed(first.filter("at = 1"), docs))
