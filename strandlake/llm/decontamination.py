"""Benchmark decontamination by pigeonhole edit matching on words.

A test item is taken as units of at most UNIT words (longer items as overlapping units, so that a long enough part of an
item is found as well). A unit of m words may be edited in e = floor(m * ERROR_RATE) words; cut into e + 1 pieces, at
least one piece stands unchanged in every passage within that distance. All piece hits in a document are found by exact
look-up, and each gives a window of the document that Myers' bit-parallel distance verifies.

Words are runs of letters and digits, in lower case; each letter of a script that is written without spaces (Han, kana,
Thai, Lao, Burmese, Khmer) is a word. An item of fewer than MIN_WORDS words allows no edit, and its words alone would be
met everywhere: it matches where it stands exactly as whole sentences or lines, between marks, line ends or ends of the
text. Items without a word and null items match nothing. A very long item is many units, so that no mask has more than
UNIT bits; the driver holds an item's text once. Null and empty documents match nothing and are kept; documents are searched
whole; repeated rows give repeated results; an empty table on either side gives its plain result (nothing, or no match).
Columns other than doc_id and text, item_id and text are carried or ignored. The benchmark is taken in blocks of bounded
size, one pass over the documents for each, so what is sent to the executors doesn't grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .license_scan import FOLD

UNIT, STRIDE = 32, 16
ERROR_RATE = 0.2
MIN_WORDS = 5
BLOCK_CHARS = 8_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item_id:bigint,distance:int,start:int>>"


#: Letters of scripts without spaces between words, and what ends a sentence or line.
SPACELESS = re.compile("([\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
MARKS = re.compile("[\n\r.!?;:\u2026\u3002\uff01\uff1f\uff1b\uff1a]+")


def words(text: str) -> list[bytes]:
    if not text.isascii():
        text = SPACELESS.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def sentences(text: str) -> list[tuple[bytes, ...]]:
    """The words of each sentence or line that has any."""
    return [found for part in MARKS.split(text) if (found := tuple(words(part)))]


def units(tokens: list[bytes]) -> list[list[bytes]]:
    """Overlapping parts of UNIT words at most; the last ends where the item ends."""
    if len(tokens) <= UNIT:
        return [tokens]
    starts = [*range(0, len(tokens) - UNIT, STRIDE), len(tokens) - UNIT]
    return [tokens[a : a + UNIT] for a in starts]


def distance(pattern: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int]:
    """Myers: the least edit distance of the pattern to a substring of text, and where the first such one ends."""
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, k + 1
            if not best:
                break
    return (best, end) if best <= most else (most + 1, 0)


@dataclass
class Matcher:
    """A block of items; word numbers are its own."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)  # item of each unit
    masks: list[dict[int, int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    pieces: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # length -> hash -> (unit, offset)
    short: dict[tuple[bytes, ...], list[tuple[int, list[tuple[bytes, ...]]]]] = field(default_factory=dict)  # first sentence -> (item, all of them)
    chars: int = 0

    def add(self, item_id: int, text: str) -> None:
        self.chars += len(text)
        tokens = words(text)
        if len(tokens) < MIN_WORDS:
            if whole := sentences(text):
                self.short.setdefault(whole[0], []).append((item_id, whole))
            return
        for unit in units(tokens):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in unit]
            m, k = len(ids), len(self.items)
            self.items.append(item_id)
            self.sizes.append(m)
            mask: dict[int, int] = {}
            for i, c in enumerate(ids):
                mask[c] = mask.get(c, 0) | 1 << i
            self.masks.append(mask)
            parts = int(m * ERROR_RATE) + 1
            cuts = [m * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                h = int(self.hashes(np.array(ids[a:b]), b - a)[0])
                self.pieces.setdefault(b - a, {}).setdefault(h, []).append((k, a))

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """A polynomial hash of every n neighbouring ids."""
        x = ids.astype(np.uint64) + np.uint64(1)
        out = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            out *= FACTOR
            out += x[k : len(x) - n + 1 + k]
        return out

    def ready(self) -> Matcher:
        self.sorted = {n: np.array(sorted(found), np.uint64) for n, found in self.pieces.items()}
        return self

    def whole(self, text: str) -> dict[int, int]:
        """The short items that stand in a text as whole sentences, and the first word of their first place."""
        parts = sentences(text)
        out: dict[int, int] = {}
        at = 0
        for k, part in enumerate(parts):
            for item, asked in self.short.get(part, ()):
                if parts[k : k + len(asked)] == asked:
                    out.setdefault(item, at)
            at += len(part)
        return out

    def search(self, texts: list[str]) -> list[list[dict]]:
        """For each text its matches: the best place of each item."""
        get = self.vocabulary.get
        split = [words(t) for t in texts]
        ids = [[get(w, -1) for w in ws] for ws in split]
        sizes = np.array([len(x) for x in ids], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(first[-1]))
        known = np.concatenate([[0], np.cumsum(flat >= 0)])
        windows: dict[int, set[tuple[int, int]]] = {}
        for n, keys in self.sorted.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[: len(known) - n] == n)  # all n words are the benchmark's
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * FACTOR + (flat[at + k] + 1).astype(np.uint64)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p, x in zip(at[keys[place] == h].tolist(), h[keys[place] == h].tolist(), strict=True):
                doc = int(np.searchsorted(first, p, side="right")) - 1
                for unit, offset in self.pieces[n][x]:
                    windows.setdefault(doc, set()).add((unit, p - offset - int(first[doc])))
        out: list[list[dict]] = [[] for _ in texts]
        for doc, found in windows.items():
            best: dict[int, tuple[int, int]] = {}
            for unit, start in sorted(found):
                m = self.sizes[unit]
                e = int(m * ERROR_RATE)
                item = self.items[unit]
                if best.get(item, (e + 1,))[0] == 0:
                    continue
                a = max(0, start - e)
                d, end = distance(self.masks[unit], m, ids[doc][a : max(0, start) + m + e], e)
                if d <= e:
                    best[item] = min(best.get(item, (m, 0)), (d, max(0, a + end - m)))
            out[doc] = [{"item_id": i, "distance": d, "start": s} for i, (d, s) in sorted(best.items())]
        if self.short:
            for doc, text in enumerate(texts):
                if found := self.whole(text):
                    # Rows of one item may differ in length: the least distance is kept.
                    out[doc] = sorted([m for m in out[doc] if m["item_id"] not in found] + [{"item_id": i, "distance": 0, "start": s} for i, s in found.items()], key=lambda m: m["item_id"])
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Matcher]:
    """Items in blocks of about `most` characters; the driver holds one block at a time."""
    block = Matcher()
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        block.add(row[0], row[1])
        if block.chars >= most:
            yield block.ready()
            block = Matcher()
    if block.items or block.short:
        yield block.ready()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs, and matches: (item_id, distance in words, first word) by item_id, in place of any column of that name."""
    out = common.small_batches(common.boxed(docs)).withColumn("matches", F.array().cast(MATCH))
    spark = docs.sparkSession
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32())]))
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    batch = whole.slice(a, 512)
                    new = sent.value.search([t or "" for t in batch.column("text").to_pylist()])
                    both = [x + y for x, y in zip(batch.column("matches").to_pylist(), new, strict=True)]
                    i = batch.schema.get_field_index("matches")
                    yield batch.set_column(i, "matches", pa.array(both, kind))

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))
    return common.unboxed(out, docs, "matches")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with their own columns."""
    return common.unboxed(find(common.boxed(docs), benchmark).filter(F.size("matches") == 0), docs)
