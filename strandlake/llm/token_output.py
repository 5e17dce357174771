"""Token ids as checksummed, independently coded blocks.

Documents are tokenised in ascending doc_id order. Every shard (one task's range of documents) is a stream of ids cut
into blocks of BLOCK ids; a document may run over several blocks. A block is a row (shard, block, first, n_ids, payload)
of a Parquet table, so any store that Spark writes to holds it, a lost task is written again, and readers may take any
subset of blocks. The payload is

    magic "SLTB", version u8, pad u8[3], vocabulary u32, n_ids u32, n_pieces u32, crc32 of the ids u32, crc32 of all
    else u32, pieces of (ordinal u64, doc_id i64, n u32, flags u8: 1 begins, 2 ends, 4 doc_id is null), coded ids

all little-endian; the ids' checksum is over unsigned 32-bit integers, the other one over the payload with itself as 0. The coder's model starts anew in each block.

Null and empty texts are documents of the end id alone. Rows of equal doc_id stand in the order of a hash of their texts; a null
doc_id stands first. An empty table gives an empty table of blocks. Columns other than doc_id and text are ignored. A
text is tokenised whole. The tokenizer's path is a parameter; the file must exist on every executor.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import uuid
import zlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, range_coder

BLOCK = 32768
HEAD = struct.Struct("<4sB3xIIIII")
PIECE = struct.Struct("<QqIB")
BEGINS, ENDS, NULL = 1, 2, 4
END_ID = 2
#: Words whose ids a worker keeps, and as many parts of words; more are tokenised again each time.
KEPT_WORDS = 500_000
SPACES = str.maketrans("\t\n\r", "   ")
#: What the tokenizer puts at the end of each part's last id.
END_OF_PART = "</w>"
#: What a tokenizer does before its model; parts come out of it as they are, so the model alone may take them.
BEFORE_MODEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Latin text: where the library's classes of signs, and its lower case, are surely the same as ours.
LATIN = [chr(k) for k in range(0x180)]
WHITE = "\t\n\v\f\r \x85\xa0"
GAP, LETTER, NUMBER, OTHER = range(4)
KIND = np.array([GAP if c in WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in LATIN], np.uint8)
#: Lower case has as many bytes, but for this letter's, which leaves Latin.
DOTTED = "\u0130"
LOWER = np.array([ord(c if c == DOTTED else c.lower()) for c in LATIN], np.uint16)
KIND_OF_BYTE, LOWER_BYTE = np.append(KIND[:128], np.zeros(128, np.uint8)), np.append(LOWER[:128], np.arange(128, 256)).astype(np.uint8)
#: UTF-8 begins a sign of two bytes with one from the first on; the second is past Latin.
TWO_BYTES, PAST_LATIN = 0xC2, 0xC6
#: A part's key: its bytes and its length.
KEY_BYTES = 23
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes of text that are tokenised at once, but for one text.
TEXT_BYTES = 1 << 21
BLOCKS_SCHEMA = "shard int, block int, first bigint, n_ids int, payload binary"


@functools.cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin UTF-8 as bytes of lower-case parts on end, the place of each part in `data`, and its length.

    Parts are what the tokenizer treats one by one: 's 't 're 've 'm 'll 'd, runs of letters, single numbers, runs of
    other signs but white space.
    """
    u = LOWER_BYTE[np.frombuffer(data + b"   ", np.uint8)]
    kind = KIND_OF_BYTE[u]
    lead = np.flatnonzero(u >= TWO_BYTES)
    if len(lead):
        low = LOWER[(u[lead] & 31).astype(np.uint16) << 6 | u[lead + 1] & 63]
        u[lead], u[lead + 1] = low >> 6 | 0xC0, low & 63 | 0x80
        kind[lead] = kind[lead + 1] = KIND[low]
    edge = np.empty(len(u), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == NUMBER
    edge[lead + 1] = False
    # A sign ' that begins a run takes one or two letters with it; what letters follow are a part of their own.
    at = np.flatnonzero(u == ord("'"))
    at = at[edge[at]]
    one, two = u[at + 1], u[at + 2]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    for some, size in ((short, 2), (long, 3)):
        edge[some + 1] = False
        edge[some + size] |= kind[some + size] == LETTER
    first = np.flatnonzero(edge)
    size = np.diff(first, append=len(u))
    full = kind[first] != GAP
    return u[kind != GAP], first[full], size[full]


def keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers for each word, which differ between words of up to KEY_BYTES, and the words' lengths in bytes."""
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, np.int64)[words.offset :][: len(words) + 1]
    data = np.concatenate([np.frombuffer(data or b"", np.uint8)[: edges[-1]], np.zeros(3 * 8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = np.diff(edges)
    key = np.stack([eight[np.minimum(edges[:-1] + k, len(eight) - 1)] & LOW_BYTES[np.clip(size - k, 0, 8)] for k in (0, 8, 16)])
    # The last byte is the length, so that signs of code 0 count.
    key[2] = key[2] & LOW_BYTES[7] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    return key, size


class Parts:
    """Parts of words and their ids. What is found beyond KEPT_WORDS, and parts beyond KEY_BYTES, are kept for one call only."""

    def __init__(self) -> None:
        # All ids on end, where each part's begin, and its key.
        self.ids, self.edge, self.key = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros((3, 0), np.uint64)
        # Hashes of keys in their order, and the parts they stand for. Of parts with equal hashes one is found.
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, words: pa.Array, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of several different parts begin and end in them; `found` gives new ones' ids on end and how many each has."""
        key, length = keys(words)
        h = np.bitwise_xor.reduce(key * MIX[:, None])
        h = (h ^ h >> np.uint64(32)) * MIX[0]
        place, known = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if len(self.hash):
            place = self.place[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)]
            known = (self.key[:, place] == key).all(0) & (length <= KEY_BYTES)
        ids, edge = self.ids, self.edge
        new = np.flatnonzero(~known)
        if len(new):
            more, sizes = found(words.take(pa.array(new)).to_pylist())
            place[new] = np.arange(len(new)) + len(edge) - 1
            ids, edge = np.concatenate([ids, more]), np.concatenate([edge, edge[-1] + np.cumsum(sizes)])
            if len(self.edge) <= KEPT_WORDS:
                self.ids, self.edge, self.key = ids, edge, np.concatenate([self.key, key[:, new]], axis=1)
                new = new[length[new] <= KEY_BYTES]
                new = new[np.argsort(h[new])]
                at = np.searchsorted(self.hash, h[new])
                self.hash, self.place = np.insert(self.hash, at, h[new]), np.insert(self.place, at, place[new])
        return ids, edge[place], edge[place + 1]


def model_alone(tk):
    """A tokenizer for parts with a space between them: the model without what comes before, if that is known, or else the tokenizer itself."""
    from tokenizers import Tokenizer, pre_tokenizers

    if tuple(json.loads(x.__getstate__()) if x else None for x in (tk.normalizer, tk.pre_tokenizer)) != BEFORE_MODEL:
        return tk
    alone = Tokenizer(tk.model)
    alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return alone


class Kept(dict):
    """Words and their ids' bytes. What is found beyond KEPT_WORDS is kept for one call only."""

    def fill(self, words: set[str], found) -> dict[str, bytes]:
        """The ids of all words: these, and the new ones, which `found` gives."""
        new = list(words - self.keys())
        fresh = dict(zip(new, found(new), strict=True))
        if len(self) < KEPT_WORDS:
            self |= fresh
            return self
        return ChainMap(self, fresh) if fresh else self


class Encoder:
    """Ids of texts, by way of the ids of their words.

    Where `by_words`, the tokenizer drops white space and never joins over it (a vocabulary with word ends), so a text's
    ids are those of its words on end. Latin texts are cut further, in lower case and many texts at once, into the parts
    (letters, single numbers, other signs) that such a tokenizer treats one by one; they repeat more often. Other
    tokenizers take whole texts.
    """

    def __init__(self, path: str, by_words: bool) -> None:
        self.tk = tokenizer(path)
        self.by_words = by_words
        self.words, self.pieces = Kept({"": b""}), Parts()
        ends = [i for t, i in self.tk.get_vocab().items() if t.endswith(END_OF_PART)]
        self.ends = np.zeros(max([self.tk.get_vocab_size(), *ends]) + 1, bool)
        self.ends[ends] = True
        self.on_parts = model_alone(self.tk)
        # The parts are those of this kind of tokenizer: tried on a text with every sign.
        sample = "".join(LATIN).replace(DOTTED, "") + " it's I'd we'll they're you've I'm don't ab12cd, e-f ''x"
        self.latin = by_words and self.by_parts([sample.encode()])[0].tolist() == self.tk.encode(sample, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(e.ids, np.uint32) for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        latin = [self.latin and is_latin(r) for r in raw]
        out = iter(self.by_parts([r for r, yes in zip(raw, latin, strict=True) if yes]))
        # A text with a special token's sign goes as it is, since such a token may hold what parts words.
        other = {k: [t] if "<|" in t else t.translate(SPACES).split(" ") for k, (t, yes) in enumerate(zip(texts, latin, strict=True)) if not yes}
        whole = self.words.fill(set().union(*other.values()), self.apart).__getitem__
        return [next(out) if yes else np.frombuffer(b"".join(map(whole, other[k])), np.uint32) for k, yes in enumerate(latin)]

    def by_parts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of Latin texts, by way of those of their different parts."""
        data, first, size = cut(b" ".join(texts))
        edges = np.concatenate([[0], np.cumsum(size)])
        parts = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        parts = parts.dictionary_encode()
        which = parts.indices.to_numpy()
        ids, begin, end = self.pieces.find(parts.dictionary, self.in_line)
        size = (end - begin)[which]
        edges = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(edges[-1])
        place += np.repeat(begin[which] - edges[:-1], size)
        ids = ids[place]
        # A text's parts begin before its end.
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.split(ids, edges[np.searchsorted(first, ends)][:-1]) if texts else []

    def in_line(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Several different parts' ids on end, and how many each has, by one call on lines of parts; a part's last id ends it."""
        lines = [parts[a : a + 64] for a in range(0, len(parts), 64)]
        ids, sizes = [], []
        for some, e in zip(lines, self.on_parts.encode_batch_fast([" ".join(some) for some in lines], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(got):
                each = self.apart(some)
                got, cuts = np.frombuffer(b"".join(each), np.uint32), np.cumsum([len(x) // 4 for x in each])
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def apart(self, words: list[str]) -> list[bytes]:
        """Each of several different words' ids, by one call on all words with a mark between them; words that hold the mark go by themselves."""
        mark = "\x00"
        ids = self.tk.encode(mark, add_special_tokens=False).ids
        plain = [w for w in words if mark not in w]
        out: dict[str, bytes] = {}
        if len(ids) == 1:
            for a in range(0, len(plain), 4096):
                part = plain[a : a + 4096]
                got = np.array(self.tk.encode_batch_fast([f" {mark} ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(got == ids[0])
                if len(cuts) == len(part) - 1:
                    out |= zip(part, (x.tobytes() for x in np.split(got, cuts)), strict=True)
                    for w in part[1:]:
                        out[w] = out[w][4:]
        rest = [w for w in words if w not in out]
        out |= zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in self.tk.encode_batch_fast(rest, add_special_tokens=False)), strict=True)
        return [out[w] for w in words]


def is_latin(text: bytes) -> bool:
    """Whether a text may be cut into parts. NFC joins nothing without combining marks, which are not Latin in this sense."""
    if b"<|" in text:
        return False
    return text.isascii() or np.frombuffer(text, np.uint8).max() < PAST_LATIN and DOTTED.encode() not in text


@functools.cache
def encoder(path: str, by_words: bool) -> Encoder:
    return Encoder(path, by_words)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def sealed(ids: np.ndarray, pieces: list[bytes], coded: bytes, vocabulary: int) -> bytes:
    head = (b"SLTB", 3, vocabulary, len(ids), len(pieces), crc(ids))
    rest = b"".join(pieces) + coded
    return HEAD.pack(*head, zlib.crc32(rest, zlib.crc32(HEAD.pack(*head, 0)))) + rest


class Writer:
    """Cuts one shard's stream into blocks; codes a batch of blocks at a time."""

    def __init__(self, shard: int, vocabulary: int) -> None:
        self.shard, self.vocabulary = shard, vocabulary
        self.parts: list[np.ndarray] = []  # of the block that is being filled
        self.pieces: list[bytes] = []
        self.room, self.first, self.block, self.ordinal = BLOCK, 0, 0, 0
        self.full: list[tuple[np.ndarray, list[bytes], int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            part = ids[done : done + self.room]
            flags = BEGINS * (done == 0) | ENDS * (done + len(part) == len(ids)) | NULL * (doc_id is None)
            self.pieces.append(PIECE.pack(self.ordinal, doc_id or 0, len(part), flags))
            self.parts.append(part)
            self.room -= len(part)
            done += len(part)
            if not self.room:
                self.close()
        self.ordinal += 1

    def close(self) -> None:
        if self.parts:
            ids = np.concatenate(self.parts)
            self.full.append((ids, self.pieces, self.first))
            self.first += len(ids)
        self.parts, self.pieces, self.room = [], [], BLOCK

    def rows(self, all_of_them: bool) -> Iterator[pa.RecordBatch]:
        if all_of_them:
            self.close()
        while len(self.full) >= range_coder.LANES or all_of_them and self.full:
            now, self.full = self.full[: range_coder.LANES], self.full[range_coder.LANES :]
            coded = range_coder.encode([x[0] for x in now], self.vocabulary)
            payload = [sealed(ids, pieces, c, self.vocabulary) for (ids, pieces, _), c in zip(now, coded, strict=True)]
            n = len(now)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.shard] * n, pa.int32()), pa.array(range(self.block, self.block + n), pa.int32()), pa.array([x[2] for x in now], pa.int64()), pa.array([len(x[0]) for x in now], pa.int32()), pa.array(payload, pa.binary())],
                ["shard", "block", "first", "n_ids", "payload"],
            )
            self.block += n


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, up to about TEXT_BYTES of text at a time."""
    before = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // TEXT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def blocks(docs: DataFrame, path: str, by_words: bool = True, end_id: int = END_ID) -> DataFrame:
    """The table of blocks; write it with Spark's Parquet writer (`write`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, by_words)
        writer = Writer(TaskContext.get().partitionId(), encode.tk.get_vocab_size())
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in portions(whole):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
                yield from writer.rows(all_of_them=False)
        yield from writer.rows(all_of_them=True)

    # Ranges are sampled by number and hash: what the driver sees of a row is a few bytes, however long its text.
    hashed = common.documents(docs).withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS_SCHEMA)


def write(docs: DataFrame, folder: str, path: str, by_words: bool = True, end_id: int = END_ID) -> None:
    blocks(docs, path, by_words, end_id).write.option("compression", "none").parquet(folder)


def opened(payloads: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int | None, int, int]]]]:
    """Ids and pieces of each payload; a wrong magic, version, length or checksum raises ValueError."""
    heads = []
    for p in payloads:
        if len(p) < HEAD.size or p[:4] != b"SLTB" or p[4] != 3:
            raise ValueError("not a block of token ids")
        *head, seal = HEAD.unpack_from(p)
        if zlib.crc32(memoryview(p)[HEAD.size :], zlib.crc32(p[: HEAD.size - 4] + bytes(4))) != seal:
            raise ValueError("a block's checksum is wrong")
        heads.append(head[2:])
    out: list = [None] * len(payloads)
    for vocabulary in {h[0] for h in heads}:
        own = [k for k, h in enumerate(heads) if h[0] == vocabulary]
        bodies = [payloads[k][HEAD.size + heads[k][2] * PIECE.size :] for k in own]
        for k, ids in zip(own, range_coder.decode(bodies, [heads[k][1] for k in own], vocabulary), strict=True):
            if crc(ids) != heads[k][3]:
                raise ValueError("a block's checksum is wrong")
            pieces = [PIECE.unpack_from(payloads[k], HEAD.size + i * PIECE.size) for i in range(heads[k][2])]
            out[k] = ids, [(o, None if flags & NULL else d, n, flags) for o, d, n, flags in pieces]
    return out


def read(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the table of blocks.

    Whole pieces are finished where their block is decoded; only documents that run over several blocks are brought
    together. A shard's offset is the sum of the shards before it: one row a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Parts of equal size, since a few blocks take the time of many.
            step = -(-whole.num_rows // max(1, -(-whole.num_rows // range_coder.LANES)))
            for a in range(0, whole.num_rows, max(1, step)):
                batch = whole.slice(a, step)
                rows: dict[str, list] = {k: [] for k in ("shard", "ordinal", "doc_id", "at", "n", "whole", "crc", "ids")}
                for (ids, pieces), shard, first in zip(opened(batch.column("payload").to_pylist()), batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True):
                    k = 0
                    for ordinal, doc_id, n, flags in pieces:
                        raw = ids[k : k + n].astype("<u4").tobytes()
                        one = flags & BEGINS and flags & ENDS
                        for c, v in zip(rows, (shard, ordinal, doc_id, first + k, n, bool(one), zlib.crc32(raw) if one else None, None if one else raw), strict=True):
                            rows[c].append(v)
                        k += n
                kinds = dict(shard=pa.int32(), ordinal=pa.int64(), doc_id=pa.int64(), at=pa.int64(), n=pa.int64(), whole=pa.bool_(), crc=pa.int64(), ids=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in rows], list(rows))

    pieces = common.stored(table.select("shard", "first", "payload").mapInArrow(run, "shard int, ordinal bigint, doc_id bigint, at bigint, n bigint, whole boolean, crc bigint, ids binary"), "token-pieces")
    totals = pieces.groupBy("shard").agg(F.sum("n").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    split = (
        pieces.filter("not whole").groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .select("shard", "doc_id", "at", "n", F.crc32(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))).alias("crc"))
    )
    found = pieces.filter("whole").select("shard", "doc_id", "at", "n", "crc").unionByName(split)
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, by_words: bool = True, end_id: int = END_ID) -> DataFrame:
    """Writes the blocks to the shared folder, and gives what `read` finds in them; they are deleted then."""
    spark = docs.sparkSession
    folder = f"{common.shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write(docs, folder, path, by_words, end_id)
    table = spark.read.schema(BLOCKS_SCHEMA).parquet(folder)
    found = read(table)
    common.released(table)
    return found
