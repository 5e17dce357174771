"""Removal of repeated byte strings by suffix arrays.

Every byte that a string of `LENGTH` bytes covers which also starts earlier (in a document of smaller doc_id, or further
up in the same one) is removed. Matches lie within documents and are judged on the input.

1. Exact copies: a text that a smaller doc_id has as well is repeated from end to end; the first holder goes on alone.
2. Shards: texts in the order of doc_id, packed into rows of about SHARD bytes. A longer text is cut into pieces of SHARD
   bytes, each with the LENGTH - 1 bytes behind it, so that every string starts in just one piece.
3. Anchors (a lossless filter): of all GRAM-byte strings within LENGTH bytes the one of least hash is the anchor, so two
   equal strings of LENGTH bytes have equal anchors. A start whose anchor occurs once in the corpus can't be a repeat;
   the others, not many more than there are repeated strings, go on.
4. In each shard a suffix array of what goes on, by Larsson-Sadakane refinement (groups are ordered by the rank of the
   suffix h further on, h doubling), and Kasai's common prefixes; runs of prefixes of LENGTH bytes
   or more are equal strings, of which the first in the shard leads.
5. The leaders, as stretches of text, are merged across shards in ranges of their anchors' hashes: a binary search in a
   range's merged keys gives the first holder of each leader's key, and the bytes of both are compared. Strings whose
   bytes differ in spite of equal keys are told apart by their bytes, so no result depends on a hash.

Equal strings lead once a shard before anything is shuffled, so a passage that a third of all documents share is as many
stretches as there are shards. There are as many ranges as the input has RANGE bytes. An anchor that occurs very often
(a common line between different texts) has its strings dealt over several ranges by their own hash.

Null and empty texts have no bytes and nothing removed. Rows of equal doc_id and text are the same document and get the
same result; rows of equal doc_id and different texts follow each other by their SHA-256; a null doc_id is before all
others. Texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dedup import mixed, powers

LENGTH, GRAM = 100, 50
SPAN = LENGTH - GRAM + 1
SHARD = 1 << 20
#: Bits of a place in a shard, which has fewer than 2 * SHARD + LENGTH bytes.
PLACE_BITS = 22
RANGE = 1 << 24
#: Occurrences of an anchor for each range that its strings are dealt over.
HOT = 1 << 12
COUNT_BITS = 5
FIRST = -(1 << 63)
SHARDS_SCHEMA = "shard bigint, docs array<bigint>, shas array<binary>, bases array<bigint>, lengths array<bigint>, ends array<bigint>, flat binary"


@functools.lru_cache(1)
def power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(size)


def rolling(flat: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes on end."""
    n = len(flat)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = power_table(max(1 << PLACE_BITS - 1, 1 << n.bit_length()))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    term = flat.astype(np.uint64)
    term += np.uint64(1)
    term *= up[:n]
    np.cumsum(term, out=total[1:])
    del term
    out = total[size:] - total[: n + 1 - size]
    out *= down[: len(out)]
    return mixed(out)


def starts_within(ends: np.ndarray, n: int) -> np.ndarray:
    """Which places begin LENGTH bytes of one document."""
    ok = np.zeros(n, bool)
    a = 0
    for b in ends.tolist():
        ok[a : max(a, b - LENGTH + 1)] = True
        a = b
    return ok


def anchors(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places that begin LENGTH bytes of one document; the place of the anchor of each; all anchors' places and hashes."""
    n = len(flat)
    ok = np.flatnonzero(starts_within(ends, n))
    if not len(ok):
        return ok, ok, ok, np.zeros(0, np.uint64)
    h = rolling(flat, GRAM)
    # One width for all shards: equal strings have equal anchors wherever they are; of equal keys the first counts.
    bits = np.uint64(PLACE_BITS)
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = h & ~low
    key |= np.arange(len(h), dtype=np.uint64)
    step, least = 1, key
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < SPAN:
        least = np.minimum(least[: len(key) - SPAN + 1], least[SPAN - step :])
    of = (least[ok] & low).astype(np.int64)
    place = np.unique(of[np.flatnonzero(np.diff(of, prepend=-1))])
    # Least hashes crowd at the low end; mixed again they are even.
    return ok, of, place, mixed(h[place])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key space; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split_up(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted keys by range, with the range's number."""
    b = bucket_of(keys, buckets)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    for k, a in enumerate(cut.tolist()):
        yield int(b[a]), keys[a : cut[k + 1] if k + 1 < len(cut) else len(keys)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes.

    Larsson and Sadakane's refinement: the places of a group agree on h bytes; they are ordered by the rank of the place
    h further on, and groups of one leave.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    order = order.astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(slots):
        place = order[slots]
        pair = rank[place].astype(np.int64) * (n + 1) + (rank[np.minimum(place + h, n)] + 1)
        by = np.argsort(pair)
        place, pair = place[by], pair[by]
        order[slots] = place
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        size = np.diff(np.append(first, len(slots)))
        rank[place] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


def kasai(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, as far as `most`.

    Kasai's bound, that a suffix shares at least one byte less than the suffix that starts one earlier, is used from
    coarse to fine: a place begins with what the place `step` before it leaves.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + most + 8, 8), (1, 1)).copy().view("<u8")[:, 0]
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    common_ = np.zeros(n, np.int32)
    step = 64
    while step:
        at = np.arange(0, n, 64) if step == 64 else np.arange(step, n, 2 * step)
        at = at[before[at] >= 0]
        have = np.zeros(len(at), np.int32) if step == 64 else np.maximum(0, common_[at - step] - step)
        other = before[at]
        live = np.arange(len(at))
        while len(live):
            i, j, k = at[live], other[live], have[live]
            same = words[np.minimum(i + k, n + most)] ^ words[np.minimum(j + k, n + most)]
            whole = same == 0
            part = same[~whole]
            have[live[~whole]] += (np.log2((part & (~part + np.uint64(1))).astype(np.float64)).astype(np.int32)) // 8
            go = live[whole]
            have[go] += 8
            live = go[have[go] < most]
        # Past the end of the text nothing is shared.
        common_[at] = np.minimum(np.minimum(have, most), n - np.maximum(at, other))
        step //= 2
    return common_[order]


def first_of_equals(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place in `starts`, the least place in it that begins the same LENGTH bytes."""
    order = suffix_array(text)
    group = np.cumsum(kasai(text, order, LENGTH) < LENGTH)
    of = np.empty(len(text), np.int64)
    of[order] = group
    own = of[starts]
    least = np.full(int(group[-1]) + 1, len(text), np.int64)
    np.minimum.at(least, own, starts)
    return least[own]


def examined(flat: np.ndarray, ends: np.ndarray, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts that repeat an earlier one of the shard, and leaders, as masks; and the range of each leader in order.
    `answers` has the bytes of `occurring_again` for the shard's distinct anchor hashes."""
    n = len(flat)
    ok, of, place, h = anchors(flat, ends)
    again, leads = np.zeros(n, bool), np.zeros(n, bool)
    distinct = np.unique(h)
    dealt = np.zeros(n, np.int64)
    dealt[place] = levels(answers, distinct, buckets)[np.searchsorted(distinct, h)]
    go = np.zeros(n, bool)
    go[ok[dealt[of] > 0]] = True
    edge = np.diff(go.astype(np.int8), prepend=0, append=0)
    run, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(run):
        return again, leads, np.zeros(0, np.int64)
    # The runs on end, each with the LENGTH - 1 bytes that its last start reads.
    size = end - run + LENGTH - 1
    offset = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(int(offset[-1])) + np.repeat(run - offset[:-1], size)
    starts = np.flatnonzero(go[source] & (np.arange(len(source)) < np.repeat(offset[:-1] + end - run, size)))
    lead = first_of_equals(flat[source], starts)
    again[source[starts[lead != starts]]] = True
    leads[source[starts[lead == starts]]] = True
    return again, leads, ranges(flat, leads, ok, of, place, h, dealt, buckets)


def ranges(flat: np.ndarray, leads: np.ndarray, ok: np.ndarray, of: np.ndarray, place: np.ndarray, h: np.ndarray, dealt: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each leader: that of its anchor's hash, or for a frequent anchor that of a mixture with its own hash."""
    anchor = of[leads[ok]]
    key = h[np.searchsorted(place, anchor)]
    many = np.flatnonzero(dealt[anchor] > 1)
    if len(many):
        own = rolling(flat, LENGTH)[np.flatnonzero(leads)[many]] & (np.uint64(1) << (dealt[anchor[many]] - 1).astype(np.uint64)) - np.uint64(1)
        key[many] = mixed(key[many] + own * np.uint64(0x9E3779B97F4A7C15))
    return bucket_of(key, buckets)


def stretches(flat: np.ndarray, starts: np.ndarray) -> bytes:
    """What the strings at `starts` (in order) cover, on end, followed by a bit for each byte: whether a string starts."""
    last = np.flatnonzero(np.diff(starts, append=1 << 40) >= LENGTH)
    first = np.concatenate([[0], last[:-1] + 1])
    size = starts[last] - starts[first] + LENGTH
    offset = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(int(offset[-1])) + np.repeat(starts[first] - offset[:-1], size)
    mask = np.zeros(len(source), bool)
    mask[starts - np.repeat(starts[first] - offset[:-1], last - first + 1)] = True
    return flat[source].tobytes() + np.packbits(mask).tobytes()


def stretched(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Text and starts of `stretches`."""
    n = len(blob) * 8 // 9
    both = np.frombuffer(blob, np.uint8)
    return both[:n], np.flatnonzero(np.unpackbits(both[n:], count=n))


def packed(docs: DataFrame) -> DataFrame:
    """Rows of about SHARD bytes, in order; shard rises with doc_id. Of docs (o, sha, text), a row without text is the
    mark of a copy, which is left out like the repeats of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes, int, int, bytes]] = []
        size, passed = 0, None

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(x[4]) for x in held])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            values = (shard, *([x[k] for x in held] for k in range(4)), ends, b"".join(x[4] for x in held))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "docs", "shas", "bases", "lengths", "ends", "flat"])

        for batch in batches:
            for o, sha, text in zip(batch.column("o").to_pylist(), batch.column("sha").to_pylist(), batch.column("text"), strict=True):
                if (o, sha) == passed:  # a copy's mark stands before it, and the row itself before its repeats
                    continue
                passed = (o, sha)
                if not text.is_valid:
                    continue
                whole = text.as_py().encode("utf-8", "surrogatepass")
                for base in range(0, len(whole) - LENGTH + 1, SHARD):
                    held.append((o, sha, base, len(whole), whole[base : base + SHARD + LENGTH - 1]))
                    size += len(held[-1][4])
                    if size >= SHARD:
                        yield row()
                        held, size, shard = [], 0, shard + 1
        if held:
            yield row()

    return docs.repartitionByRange("o", "sha").sortWithinPartitions("o", "sha", F.col("text").asc_nulls_first()).mapInArrow(run, SHARDS_SCHEMA)


def arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch.column("flat")[k].as_py(), np.uint8), np.array(batch.column("ends")[k].as_py(), np.int64)


def rows_of(shard: list[int], bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], ["shard", "bucket", "blob"])


BLOBS = "shard bigint, bucket int, blob binary"


def fingerprints(shards: DataFrame, buckets: int) -> DataFrame:
    """Each shard's distinct anchor hashes by range of the hash; the lowest bits say how often the shard has it, as a
    number of binary digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << COUNT_BITS) - 1)
        for batch in batches:
            for k in range(batch.num_rows):
                h, count = np.unique(anchors(*arrays(batch, k))[3], return_counts=True)
                digits = np.frexp(count.astype(np.float64))[1].astype(np.uint64)
                cut = list(split_up(h & ~low | digits, buckets))
                yield rows_of([batch.column("shard")[k].as_py()] * len(cut), [b for b, _ in cut], [x.tobytes() for _, x in cut])

    return shards.select("shard", "ends", "flat").mapInArrow(run, BLOBS)


def occurring_again(group: pd.DataFrame, hot: int) -> pd.DataFrame:
    """For each shard's hashes of a range, a byte: 0 for an anchor that all shards together have once, else one more than
    the binary logarithm of how many ranges the strings of that anchor are dealt over."""
    each = [np.frombuffer(b, np.uint64) for b in group["blob"]]
    all_ = np.concatenate(each)
    plain, where = np.unique(all_ >> np.uint64(COUNT_BITS), return_inverse=True)
    digits = (all_ & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
    count = np.bincount(where, weights=np.exp2(digits - 1), minlength=len(plain))  # within a factor of two; 1 is exact
    dealt = np.where(count > 1, 1 + np.ceil(np.log2(np.maximum(1, count / hot))), 0).astype(np.uint8)
    group["blob"] = [x.tobytes() for x in np.split(dealt[where], np.cumsum([len(x) for x in each])[:-1])]
    return group[["shard", "bucket", "blob"]]


def same_strings(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at x and at y are the same; words[i] has the eight bytes from i on."""
    same = words[x] == words[y]
    for k in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[x + k] == words[y + k]
    return same


def held_before(group: pd.DataFrame) -> pd.DataFrame:
    """For each shard's leaders of a range, bits of those that an earlier shard holds: a binary search in the merged keys
    gives the first holder of the key, whose bytes decide."""
    group = group.sort_values("shard", ignore_index=True)
    texts, places, keys, at = [], [], [], 0
    for blob in group["blob"]:
        text, starts = stretched(blob)
        texts.append(text)
        keys.append(rolling(text, LENGTH)[starts])
        places.append(starts + at)
        at += len(text)
    sizes = [len(x) for x in places]
    flat, place, key, row = np.concatenate([*texts, np.zeros(8, np.uint8)]), np.concatenate(places), np.concatenate(keys), np.repeat(np.arange(len(sizes)), sizes)
    words = np.ndarray((len(flat) - 7,), "<u8", flat.tobytes(), 0, (1,))
    # In the order of the keys, so that the search goes through the merged ones from end to end.
    by = np.argsort(key, kind="stable")
    keys_ = key[by]
    new = np.concatenate([[True], keys_[1:] != keys_[:-1]])
    merged, first = keys_[new], by[new]
    holder = np.empty(len(by), np.int64)
    holder[by] = first[np.searchsorted(merged, keys_)]
    same = np.ones(len(by), bool)
    other = np.flatnonzero(holder != np.arange(len(by)))
    same[other] = same_strings(words, place[other], place[holder[other]])
    held = same & (row[holder] < row)
    if not same.all():  # different strings of one key
        seen: set[bytes] = set()
        for k in np.flatnonzero(np.isin(key, key[~same])).tolist():
            string = flat[place[k] : place[k] + LENGTH].tobytes()
            held[k] = string in seen
            seen.add(string)
    group["blob"] = [np.packbits(x).tobytes() for x in np.split(held, np.cumsum(sizes)[:-1])]
    return group[["shard", "bucket", "blob"]]


def levels(answers: list[dict], keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bytes that came back for a shard's sorted anchor hashes, range by range."""
    got = {a["bucket"]: a["blob"] for a in answers or ()}
    out = [np.frombuffer(got[b], np.uint8) for b, _ in split_up(keys, buckets)]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def by_range(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range, and which of the leaders are in it, in order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for k, a in enumerate(cut.tolist()):
        yield int(bucket[order[a]]), order[a : cut[k + 1] if k + 1 < len(cut) else len(order)]


def answered(blobs: DataFrame, judge) -> DataFrame:
    bits = blobs.groupBy("bucket").applyInPandas(judge, BLOBS)
    return common.stored(bits.groupBy("shard").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers")), "answers")


def leaders(shards: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Bucket -1: the masks of repeats and of leaders, packed, and the leaders' ranges; other buckets: the leaders in
    stretches of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat, ends = arrays(batch, k)
                again, leads, bucket = examined(flat, ends, batch.column("answers")[k].as_py(), buckets)
                place = np.flatnonzero(leads)
                cut = list(by_range(bucket))
                masks = np.packbits(np.concatenate([again, leads])).tobytes() + bucket.astype("<u4").tobytes()
                yield rows_of([batch.column("shard")[k].as_py()] * (len(cut) + 1), [-1, *(b for b, _ in cut)], [masks, *(stretches(flat, place[x]) for _, x in cut)])

    return shards.select("shard", "ends", "flat").join(answers, "shard", "left").select("shard", "ends", "flat", "answers").mapInArrow(run, BLOBS)


def spans_of(starts: np.ndarray, n: int) -> np.ndarray:
    """Which bytes the strings of LENGTH bytes at `starts` cover."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    step[at] = 1
    step[: n + 1] -= np.bincount(at + LENGTH, minlength=n + 1).astype(np.int32)
    return np.cumsum(step)[:n] > 0


def judged(shards: DataFrame, masks: DataFrame, answers: DataFrame) -> DataFrame:
    """o, sha, spans and whole of every piece of the shards; of whole texts kept_sha256 as well."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat, ends = arrays(batch, k)
                n = len(flat)
                blob = batch.column("masks")[k].as_py()
                edge = -(-2 * n // 8)
                both = np.unpackbits(np.frombuffer(blob, np.uint8, edge), count=2 * n).astype(bool)
                again, place = both[:n].copy(), np.flatnonzero(both[n:])
                bits = {a["bucket"]: a["blob"] for a in batch.column("answers")[k].as_py() or ()}
                for b, x in by_range(np.frombuffer(blob, "<u4", offset=edge).astype(np.int64)):
                    again[place[x]] |= np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(x)).astype(bool)
                gone = spans_of(again, n)
                shas, bases, lengths, spans, kept, whole = batch.column("shas")[k].as_py(), batch.column("bases")[k].as_py(), batch.column("lengths")[k].as_py(), [], [], []
                a = 0
                for b, sha, base, length in zip(ends.tolist(), shas, bases, lengths, strict=True):
                    own = gone[a:b]
                    edges = np.diff(own.astype(np.int8), prepend=0, append=0) if own.any() else np.zeros(0)
                    spans.append([{"start": base + s, "end": base + e} for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)])
                    whole.append(b - a == length)
                    kept.append((hashlib.sha256(flat[a:b][~own].tobytes()).digest() if spans[-1] else sha) if whole[-1] else None)
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("docs")[k].as_py(), pa.int64()), pa.array(shas, pa.binary()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(whole)], ["o", "sha", "spans", "kept_sha256", "whole"])

    rows = shards.join(masks, "shard").join(answers, "shard", "left").select("shard", "docs", "shas", "bases", "lengths", "ends", "flat", "masks", "answers")
    return rows.mapInArrow(run, "o bigint, sha binary, spans array<struct<start:bigint,end:bigint>>, kept_sha256 binary, whole boolean")


def joined(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """o, sha, spans and kept_sha256 of the texts that were cut into pieces."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, parts in zip(batch.column("text"), batch.column("parts").to_pylist(), strict=True):
                own: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for part in parts for s in part):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(hashlib.sha256(kept_text(text.as_py().encode("utf-8", "surrogatepass"), own)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("sha"), pa.array(spans, span), pa.array(kept, pa.binary())], ["o", "sha", "spans", "kept_sha256"])

    rows = pieces.groupBy("o", "sha").agg(F.collect_list("spans").alias("parts")).join(texts, ["o", "sha"]).dropDuplicates(["o", "sha"])
    return rows.select("o", "sha", "text", "parts").mapInArrow(run, "o bigint, sha binary, spans array<struct<start:bigint,end:bigint>>, kept_sha256 binary")


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes: start, end) and kept_sha256 (of the rest), a row for each of docs."""
    t = common.documents(docs)
    hashed = t.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("o"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    every = common.stored(hashed, "text-hashes")
    firsts = common.stored(every.filter(f"n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("o").alias("first"), F.first("n_bytes").alias("n")), "first-holders")
    buckets = max(1, -(-(firsts.agg(F.sum("n")).first()[0] or 0) // RANGE))
    firsts = firsts.select("sha", "first")
    texts = t.filter(F.octet_length("text") >= LENGTH).select(F.coalesce("doc_id", F.lit(FIRST)).alias("o"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    copies = every.join(firsts, "sha").filter("o != first").select("o", "sha", F.lit(None).cast("string").alias("text"))
    shards = common.stored(packed(texts.unionByName(copies)), "shards")
    seen = answered(fingerprints(shards, buckets), lambda group: occurring_again(group, hot))
    marks = common.stored(leaders(shards, seen, buckets), "marks")
    before = answered(marks.filter("bucket >= 0"), held_before)
    results = common.stored(judged(shards, marks.filter("bucket = -1").select("shard", F.col("blob").alias("masks")), before), "judged")
    common.released(shards, seen, marks, before)
    pieces = results.filter("not whole").select("o", "sha", "spans")
    results = results.filter("whole").select("o", "sha", "spans", "kept_sha256")
    if not pieces.isEmpty():
        results = results.unionByName(common.stored(joined(pieces, texts), "judged-pieces"))
    found = every.join(firsts, "sha", "left").join(results.withColumnRenamed("o", "first"), ["sha", "first"], "left")
    copy = (F.col("n_bytes") >= LENGTH) & (F.col("o") != F.col("first"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    return found.select(
        "doc_id", "n_bytes", F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")
    )


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
