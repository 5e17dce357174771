"""Suffixes as short binary keys, so that they are sorted and shuffled in a third of their letters; letters in order as text.

A key holds three letters a byte, as digits of base 6 (the end is 0 and the letters stand in their order), then the letter
before where that is part of the order, the read, the place, the letter before and what is carried. The end is always among
the digits, so no key's letters begin another's, and keys compare as (suffix, read) do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.bases import ALPHABET

#: Bytes of a read's number and of a place in it; bytes of keys that are made at a time.
READ, PLACE, STEP = 5, 3, 16 << 20
DIGIT = np.full(256, 255, np.uint8)
DIGIT[[ord(c) for c in ALPHABET[1:]]] = np.arange(1, len(ALPHABET))
LETTERS = pa.array(list(ALPHABET))
BYTES = pa.array([None, *map(chr, range(1, 128))])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value begins (and the last ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, on end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def big_endian(values: np.ndarray, size: int) -> np.ndarray:
    if len(values) and (values.min() < 0 or values.max() >> (8 * size)):
        raise ValueError(f"a number does not fit into {size} bytes")
    return values.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]


#: Letters at a suffix's start by which the order is made in passes, and how many such starts there are.
HEAD = 6
HEADS = len(ALPHABET) ** HEAD


def heads_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For reads on end: digits with three ends behind each read, three letters from each digit on as a byte, the code of HEAD letters
    from there on, whether a suffix begins there, and where the reads begin."""
    size = np.diff(at)
    begin = np.cumsum(size + 3) - (size + 3)
    close = begin + size
    letters = np.frombuffer(data[at[0] : at[-1]].tobytes().translate(DIGIT.tobytes()), np.uint8)
    if (letters == 255).any():
        raise ValueError(f"reads hold letters other than {ALPHABET[1:]}")
    there = np.ones(int((size + 3).sum()), bool)
    there[close[:, None] + np.arange(3)] = False
    digits = np.zeros(len(there) + 5, np.uint8)
    digits[:-5][there] = letters
    there[close] = True
    triples = digits[:-2] * np.uint8(36) + digits[1:-1] * np.uint8(6) + digits[2:]
    code = triples[:-3].astype(np.uint16) * np.uint16(216)
    more = triples[3:].astype(np.uint16)
    # Behind a read's last two letters, three letters on stand those of the next read.
    for k in range(3):
        more[np.maximum(close - k, begin)] = 0
    return digits, triples, code + more, there, begin


def head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head (a code of HEAD letters) and n, how many suffixes of a partition's reads (bases) begin with it."""
    counts = np.zeros(HEADS, np.int64)
    for whole in batches:
        for batch in slices(whole, 0, LOOKED) if whole.num_rows else ():
            _, _, code, there, _ = heads_of(*flat(batch.column(0)))
            counts += np.bincount(code[there], minlength=HEADS)
    found = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(found), pa.array(counts[found])], ["head", "n"])


def keys_of(batch: pa.RecordBatch, sap: bool, longest: int | None, heads: tuple[int, int]) -> pa.RecordBatch:
    """key of every suffix of the batch's reads (seq_id, bases, columns carried) with such a head, or of those of at most `longest` letters."""
    data, at = flat(batch.column(1))
    size = np.diff(at)
    digits, triples, code, there, begin = heads_of(data, at)
    if heads != (0, HEADS):
        there &= (code >= heads[0]) & (code < heads[1])
    start = np.flatnonzero(there)
    of = np.searchsorted(begin, start, "right") - 1
    places = start - begin[of]
    if longest is not None:
        short = size[of] - places <= longest
        places, of, start = places[short], of[short], start[short]
    coded = (size[of] - places) // 3 + 1
    before = np.where(places > 0, digits[np.maximum(start - 1, 0)], 0)
    tail = [before[:, None]] if sap else []
    tail += [big_endian(batch.column(0).to_numpy(zero_copy_only=False), READ)[of], big_endian(places, PLACE), before[:, None]]
    for column in batch.columns[2:]:
        text, offsets = flat(column)
        if not np.array_equal(np.diff(offsets), size) or (text[offsets[0] : offsets[-1]] > 127).any():
            raise ValueError("a carried column is no string of one byte a base")
        tail.append(np.where(places > 0, text[np.maximum(offsets[of] + places - 1, 0)], 0)[:, None] if len(text) else np.zeros((len(places), 1), np.uint8))
    tail = np.concatenate(tail, axis=1).astype(np.uint8)
    length = coded + tail.shape[1]
    ends = np.cumsum(length)
    out = np.empty(int(length.sum()), np.uint8)
    step = steps(coded)
    out[np.repeat(ends - length, coded) + step] = triples[np.repeat(start, coded) + 3 * step]
    out[(ends - tail.shape[1])[:, None] + np.arange(tail.shape[1])] = tail
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.record_batch([pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])], ["key"])


def packed(batches: Iterator[pa.RecordBatch], sap: bool, longest: int | None = None, heads: tuple[int, int] = (0, HEADS)) -> Iterator[pa.RecordBatch]:
    """The keys of reads. heads: only suffixes whose first letters have these codes, from the first to the one before the last."""
    for batch in batches:
        size = np.diff(flat(batch.column(1))[1])
        # A read's keys are as long as a sixth of its length squared; of a part of the heads, batches are larger.
        part = np.cumsum((size + 1) * (size // 6 + 24)) // (STEP if heads == (0, HEADS) else 4 * STEP)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield keys_of(batch.slice(a, b - a), sap, longest, heads)


def split(key: bytes, tail: int) -> str:
    """The suffix of a key."""
    return "".join(ALPHABET[d] for b in key[: len(key) - tail] for d in (b // 36, b // 6 % 6, b % 6)).rstrip(ALPHABET[0])


def table_of(keys: pa.Array, last: bytes | None, extra: int, sap: bool, edges: tuple[bool, bool], names: list[str]) -> pa.RecordBatch:
    """The rows of keys in order; last: the key before the first one. edges: whether a partition begins, and ends, here."""
    tail = READ + PLACE + 1 + extra + sap
    first = keys[0].as_py()
    data, at = flat(pa.concat_arrays([pa.array([first if last is None else last], pa.binary()), keys]))
    end = at[1:] - tail
    close = data[end - 1]
    length = 3 * (np.diff(at) - tail - 1) + (close >= 36) + (close % 36 >= 6)
    now = end[1:] + sap
    number = lambda k, n: sum(data[now + k + i].astype(np.int64) << (8 * (n - 1 - i)) for i in range(n))
    letter = LETTERS.take(pa.array(data[end + sap + READ + PLACE]))
    n = len(keys)

    def shared() -> pa.Array:
        size = np.diff(at) - tail
        both = np.minimum(size[1:], size[:-1])
        step = steps(both)
        a, b = np.repeat(at[1:-1], both) + step, np.repeat(at[:-2], both) + step
        starts = np.cumsum(both) - both
        same = np.minimum(np.minimum.reduceat(np.where(data[a] != data[b], step, np.iinfo(np.int64).max), starts), both)
        x, y = (data[np.minimum(q + same, len(data) - 1)] for q in (at[1:-1], at[:-2]))
        high, middle = x // 36 == y // 36, x // 6 == y // 6
        return headless(pa.array(np.where(same < both, 3 * same + high + (high & middle), length[1:]).astype(np.int32)))

    def headless(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.nulls(1, column.type), column.slice(1)]) if last is None else column

    def edge() -> pa.Array:
        texts = [None] * n
        if edges[0]:
            texts[0] = split(first, tail)
        if edges[1]:
            texts[-1] = split(keys[-1].as_py(), tail)
        return pa.array(texts, pa.string())

    made = {
        "pile": lambda: LETTERS.take(pa.array(data[at[1:-1]] // 36)),
        "ch": lambda: letter.slice(1),
        "seq_id": lambda: pa.array(number(0, READ)),
        "pos": lambda: pa.array(number(READ, PLACE).astype(np.int32)),
        "length": lambda: pa.array(length[1:].astype(np.int32)),
        "lcp": shared,
        "prev": lambda: headless(letter.slice(0, n)),
        "edge": edge,
    } | {f"c{k}": lambda k=k: BYTES.take(pa.array(data[now + READ + PLACE + 1 + k])) for k in range(extra)}
    return pa.record_batch([made[name]() for name in names], names)


def unpacked(batches: Iterator[pa.RecordBatch], extra: int, sap: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's keys in order, with the columns named of: pile, ch, seq_id, pos, length (of the suffix), lcp and prev
    (common prefix with the row before, and its letter; null in a partition's first row), edge (the suffix of a partition's first
    and last row), and what is carried (c0, ...)."""
    last, held, begins = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield table_of(held, last, extra, sap, (begins, False), names)
            last, begins = held[-1].as_py(), False
        held = batch.column(0)
    if held is not None:
        yield table_of(held, last, extra, sap, (begins, True), names)


#: What stands in a text where no letter was given; texts that are looked through at a time.
GAP, TEXTS = ord("."), 64


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def texts(batches: Iterator[pa.RecordBatch], block: int, gaps: bool) -> Iterator[pa.RecordBatch]:
    """Letters (rank, ch) of `block` ranks on end as text: block, at (the text's place in it), text, n (its letters).

    A text ends where a rank is missing; with gaps, a mark stands there. Rows in another order are right too, in more texts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        rank = batch.column(0).to_numpy(zero_copy_only=False)
        data, at = flat(batch.column(1))
        letter = data[at[:-1]]
        if (rank[1:] < rank[:-1]).any():
            order = np.argsort(rank, kind="stable")
            rank, letter = rank[order], letter[order]
        of = rank // block
        begins = of[1:] != of[:-1] if gaps else (of[1:] != of[:-1]) | (rank[1:] != rank[:-1] + 1)
        first = np.flatnonzero(np.r_[True, begins])
        n = np.diff(np.r_[first, len(rank)])
        size = rank[first + n - 1] - rank[first] + 1
        ends = np.cumsum(size)
        text = np.full(ends[-1], GAP, np.uint8)
        text[np.repeat(ends - size - rank[first], n) + rank] = letter
        yield pa.record_batch([pa.array(of[first]), pa.array((rank[first] - of[first] * block).astype(np.int32)), strings(text, ends), pa.array(n)], ["block", "at", "text", "n"])


def run_rows(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """run_no, first_rank, ch, run of blocks' run heads: block, pieces (at, text with gaps), before (runs), next (the head behind)."""
    for whole in batches:
        for k in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(k, TEXTS)
            lists = batch.column(1)
            pieces = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            data, at = flat(pieces.field(1))
            size = np.diff(at)
            number, before, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            text = data[at[0] : at[-1]]
            rank = np.repeat(number[of] * block + pieces.field(0).to_numpy(zero_copy_only=False), size) + steps(size)
            there = text != GAP
            rank, row, letter = rank[there], np.repeat(of, size)[there], text[there]
            order = np.lexsort((rank, row))
            rank, row, letter = rank[order], row[order], letter[order]
            counts = np.bincount(row, minlength=len(lists))
            ends = np.cumsum(counts) - 1
            nxt = np.r_[rank[1:], 0]
            nxt[ends] = after
            yield pa.record_batch([pa.array(np.repeat(before, counts) + steps(counts)), pa.array(rank), strings(letter, np.arange(1, len(letter) + 1)), pa.array(nxt - rank)], ["run_no", "first_rank", "ch", "run"])


def followed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """rank, ch, occ, lf of an index's rows: block, letters, begins (where the letters' piles begin), and how often each stands before."""
    for whole in batches:
        for k in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(k, TEXTS)
            data, at = flat(batch.column(1))
            size = np.diff(at)
            letter = data[at[0] : at[-1]]
            row = np.repeat(np.arange(len(size)), size)
            occ, to = np.empty(len(letter), np.int64), np.empty(len(letter), np.int64)
            begins = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)
            for c, name in enumerate(ALPHABET):
                here = np.flatnonzero(letter == ord(name))
                counts = np.bincount(row[here], minlength=len(size))
                occ[here] = np.repeat(batch.column(3 + c).to_numpy(zero_copy_only=False), counts) + steps(counts)
                to[here] = occ[here] + begins[row[here], c]
            rank = np.repeat(batch.column(0).to_numpy(zero_copy_only=False) * block, size) + steps(size)
            yield pa.record_batch([pa.array(rank), strings(letter, np.arange(1, len(letter) + 1)), pa.array(occ), pa.array(to)], ["rank", "ch", "occ", "lf"])


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of a string column (a row at least)."""
    part = (flat(batch.column(column))[1][1:] - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


#: Letters A to Z and a to z as capitals, what else there is, and one for each letter and none for others.
CAPITALS = bytes(range(256)).upper()
OTHERS = bytes(c for c in range(256) if not ord("A") <= CAPITALS[c] <= ord("Z"))
IS_LETTER = bytes(int(c not in OTHERS) for c in range(256))


def pieces_of(batches: Iterator[pa.RecordBatch], length: int, maps: tuple[bytes, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The letters A to Z and a to z of texts (a key, text) in pieces of `length`: key, piece, and the piece by each map of 256 bytes."""
    for whole in batches:
        for batch in slices(whole, 1, STEP >> 2):
            data, at = flat(batch.column(1))
            text = data[at[0] : at[-1]].tobytes()
            letters, size = text.translate(CAPITALS, OTHERS), np.zeros(len(at) - 1, np.int64)
            some = at[1:] > at[:-1]
            if some.any():
                size[some] = np.add.reduceat(np.frombuffer(text.translate(IS_LETTER), np.uint8), at[:-1][some] - at[0], dtype=np.int64)
            n = -(-size // length)
            of, piece = np.repeat(np.arange(len(size)), n), steps(n)
            ends = np.cumsum(np.minimum(size[of] - piece * length, length))
            yield pa.record_batch([batch.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), *[strings(np.frombuffer(letters.translate(m), np.uint8), ends) for m in maps]], names)


#: Bases as digits of two bits, others 0; letters of reads that are looked at on end; letters of a filter's codes.
BITS = np.zeros(256, np.int64)
BITS[[ord(c) for c in "ACGT"]] = np.arange(4)
LOOKED, FILTERED = 1 << 20, 12


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """The code of the k letters from each place on, but for the last ones."""
    if len(data) < k:
        return np.zeros(0, np.int64)
    part = np.frombuffer(data.tobytes().translate(BITS.astype(np.uint8).tobytes()), np.uint8).astype(np.uint32 if k <= 16 else np.int64)
    code, taken, step = part[:0], 0, 1
    # Codes of 1, 2, 4, ... letters; those that k is made of are put on end.
    while True:
        if k & step:
            code = code[: len(part) - taken] << 2 * step | part[taken:] if taken else part
            taken += step
        if 2 * step > k:
            return code[: len(data) - k + 1].astype(np.int64)
        part = part[:-step] << 2 * step | part[step:]
        step *= 2


def word_counts(batches: Iterator[pa.RecordBatch], k: int, part: int | None = None) -> Iterator[pa.RecordBatch]:
    """word (of k letters, without N) and how often each letter stands before it, over all reads (bases) of a partition.

    part: a partition's number, for counts of its reads of even and of odd places each: part, odd, word, the counts; the first
    row, without a word, has the number of reads."""
    kinds = 1 if part is None else 2
    counts, reads = np.zeros(kinds * len(ALPHABET) << 2 * k, np.int64), 0
    for whole in batches:
        for batch in slices(whole, 0, LOOKED) if whole.num_rows else ():
            data, at = flat(batch.column(0))
            data, at = data[at[0] : at[-1]], at - at[0]
            letter = np.frombuffer(data.tobytes().translate(DIGIT.tobytes()), np.uint8)
            if (letter == 255).any():
                raise ValueError(f"reads hold letters other than {ALPHABET[1:]}")
            code = rolled(data, k)
            # A word begins nowhere in the last k - 1 letters of a read.
            here = np.ones(len(data), bool)
            ends = at[1:][at[1:] > 0]
            here[np.maximum(ends[:, None] - np.arange(1, k), 0)] = False
            here = here[: len(code)]
            if (letter == ALPHABET.index("N")).any():
                unknown = np.r_[0, np.cumsum(letter == ALPHABET.index("N"))]
                here &= unknown[k:] == unknown[: len(code)]
            before = np.r_[np.uint8(0), letter[:-1]][: len(code)].astype(np.int64)
            begins = at[:-1][np.diff(at) > 0]
            before[begins[begins < len(code)]] = 0
            if part is not None:
                before += len(ALPHABET) * np.repeat((reads + np.arange(len(at) - 1)) % 2, np.diff(at))[: len(code)]
            reads += len(at) - 1
            counts += np.bincount((before[here] << 2 * k) + code[here], minlength=len(counts))
    names = [f"n{c}" for c in range(len(ALPHABET))]
    if part is not None:
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([False]), pa.nulls(1, pa.string()), pa.array([reads]), *[pa.array([0])] * (len(ALPHABET) - 1)], ["part", "odd", "word", *names])
    for kind, each in enumerate(counts.reshape(kinds, len(ALPHABET), -1)):
        found = np.flatnonzero(each.any(axis=0))
        if len(found):
            letters = np.frombuffer(b"ACGT", np.uint8)[found[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
            of = [] if part is None else [pa.array(np.full(len(found), part, np.int32)), pa.array(np.full(len(found), kind == 1))]
            yield pa.record_batch([*of, strings(letters.ravel(), k * np.arange(1, len(found) + 1)), *[pa.array(n) for n in each[:, found]]], [*([] if part is None else ["part", "odd"]), "word", *names])


def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the words of a list (kmer) are marked in a filter: at (a whole number of the filter), bit."""
    for batch in batches:
        code = np.array([rolled(np.frombuffer(w.encode()[-FILTERED:], np.uint8), min(len(w.encode()), FILTERED))[0] for w in batch.column(0).to_pylist() if w], np.int64)
        yield pa.record_batch([pa.array(code >> 6), pa.array(code & 63)], ["at", "bit"])


def places_of(batches: Iterator[pa.RecordBatch], lengths: list[int], words: np.ndarray, only: bool = False) -> Iterator[pa.RecordBatch]:
    """word, seq_id, pos of the places of reads (seq_id, bases, columns carried) whose words of these lengths are marked in a filter, and
    of some others, with what is carried. only: leave out words with other letters than A, C, G and T, which have the codes of others."""
    for whole in batches:
        for batch in slices(whole, 1, LOOKED) if whole.num_rows else ():
            data, at = flat(batch.column(1))
            data, at = data[at[0] : at[-1]], at - at[0]
            size = np.diff(at)
            left = np.repeat(at[1:], size) - np.arange(len(data))
            of = np.repeat(np.arange(len(size)), size)
            other = np.r_[0, np.cumsum(~np.isin(data, np.frombuffer(b"ACGT", np.uint8)))] if only else None
            for k in lengths:
                w = min(k, FILTERED)
                code = rolled(data, w)[k - w :]
                place = np.flatnonzero((words[code >> 6] >> (code & 63) & 1 == 1) & (left[: len(code)] >= k))
                if only:
                    place = place[other[place + k] == other[place]]
                # What is carried is as long as a read for each place, so few places go on at a time.
                part = np.cumsum(size[of[place]] + k) // STEP if len(batch.columns) > 2 else np.zeros(len(place), np.int64)
                for here in np.split(place, np.flatnonzero(np.diff(part)) + 1):
                    text = data[here[:, None] + np.arange(k)].ravel()
                    rows = pa.array(of[here])
                    carried = {name: batch.column(name).take(rows) for name in batch.schema.names[2:]}
                    yield pa.record_batch([strings(text, k * np.arange(1, len(here) + 1)), batch.column(0).take(rows), pa.array((here - at[of[here]]).astype(np.int32)), *carried.values()], ["word", "seq_id", "pos", *carried])


def read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters (seq_id, cycle, base, qual) that follow each other in a read as one row: seq_id, at, bases, quals."""
    for batch in batches:
        if not batch.num_rows:
            continue
        read, cycle = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        first = np.flatnonzero(np.r_[True, (read[1:] != read[:-1]) | (cycle[1:] != cycle[:-1] + 1)])
        texts = []
        for column in batch.columns[2:]:
            data, at = flat(column)
            texts.append(strings(data[at[0] : at[-1]], np.r_[at[first[1:]], at[-1]] - at[0]))
        yield pa.record_batch([batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), *texts], ["seq_id", "at", "bases", "quals"])


#: Letters that follow a way and come along with its place; bits of a filter of ways, and what spreads their codes over it.
REST, FILTER, SPREAD = 24, 27, np.uint64(0x9E3779B97F4A7C15)


def six(digits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The code of n letters backwards from each place of the digits, the first one counting most; the ends of reads count 0."""
    code = np.zeros(len(at), np.int64)
    for t in range(n):
        code = code * 6 + digits[at - t]
    return code


def spread(key: np.ndarray) -> np.ndarray:
    """A place in the filter for each code."""
    return ((key.astype(np.uint64) * SPREAD) >> np.uint64(64 - FILTER)).astype(np.int64)


def ends_of(batch: pa.RecordBatch, k: int, step: int, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Where words of k letters without N end in reads (is_a, seq_id, bases): the read's row, ends, the word's code, the digits and
    where the letter before a word stands in them. allowed: for each code 1 if A goes on to it, 2 if B does, 3 if both do."""
    data, at = flat(batch.column(2))
    data, at = data[at[0] : at[-1]], at - at[0]
    letter = np.frombuffer(data.tobytes().translate(DIGIT.tobytes()), np.uint8)
    if (letter == 255).any():
        raise ValueError(f"reads hold letters other than {ALPHABET[1:]}")
    size, gap = np.diff(at), step + REST
    code = rolled(data, k)
    here = np.ones(len(data), bool)
    ends = at[1:][at[1:] > 0]
    here[np.maximum(ends[:, None] - np.arange(1, k), 0)] = False
    here = here[: len(code)]
    if (letter == ALPHABET.index("N")).any():
        unknown = np.r_[0, np.cumsum(letter == ALPHABET.index("N"))]
        here &= unknown[k:] == unknown[: len(code)]
    of = np.repeat(np.arange(len(size)), size)
    if allowed is not None:
        side = np.where(batch.column(0).to_numpy(zero_copy_only=False), 1, 2).astype(np.uint8)
        here &= (allowed[code] & side[of[: len(code)]]) > 0
    first = np.flatnonzero(here)
    of = of[first]
    # Each read stands behind so many zeros, for what would stand before its start.
    digits = np.zeros(len(data) + gap * len(size), np.uint8)
    digits[np.arange(len(data)) + gap * np.repeat(np.arange(1, len(size) + 1), size)] = letter
    return of, first - at[of] + k, code[first], digits, first + gap * (of + 1) - 1


#: Parts that words fall into by their codes, ways that are sorted at a time, and bytes of a step between ways and of a number.
BUCKETS, SORTED, WIDE, NUMBER = 1024, 1 << 22, 5, 4


def way_keys(batches: Iterator[pa.RecordBatch], k: int, step: int, allowed: np.ndarray | None) -> Iterator[np.ndarray]:
    """The `step` letters before each word of k letters: the word's code, the way and whether it stands in B (the last bit) as a number."""
    ways = len(ALPHABET) ** step
    for whole in batches:
        for batch in slices(whole, 2, LOOKED) if whole.num_rows else ():
            of, _, code, digits, at = ends_of(batch, k, step, allowed)
            yield code * ways + six(digits, at, step) << 1 | ~batch.column(0).to_numpy(zero_copy_only=False)[of]


def ways_in(key: np.ndarray, n: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """root, way, n_a, n_b of sorted numbers of `way_keys` and how often each stands there; a row for each way."""
    ways, way, is_b = len(ALPHABET) ** step, key >> 1, key & 1 == 1
    first = np.flatnonzero(np.r_[True, way[1:] != way[:-1]])
    way, n_a, n_b = way[first], np.add.reduceat(np.where(is_b, 0, n), first), np.add.reduceat(np.where(is_b, n, 0), first)
    for x in range(0, len(way), LOOKED):
        part = slice(x, x + LOOKED)
        yield pa.record_batch([pa.array(way[part] // ways), pa.array(way[part] % ways), pa.array(n_a[part]), pa.array(n_b[part])], ["root", "way", "n_a", "n_b"])


def few_ways(k: int, step: int) -> bool:
    """Whether all ways of all words of k letters are counted in one array."""
    return len(ALPHABET) ** step << 2 * k <= 1 << 21


def way_counts(batches: Iterator[pa.RecordBatch], k: int, step: int, allowed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """How often few ways (root, way) stand in A and in B, each way once for each side."""
    counts = np.zeros(len(ALPHABET) ** step << 2 * k + 1, np.int64)
    for key in way_keys(batches, k, step, allowed):
        counts += np.bincount(key, minlength=len(counts))
    if counts.any():
        yield from ways_in(found := np.flatnonzero(counts), counts[found], step)


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of what belongs to them."""
    key, many = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key, many = key[order], many[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
    return key[first], np.add.reduceat(many, first) if len(key) else many


def way_lists(batches: Iterator[pa.RecordBatch], k: int, step: int, allowed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What `way_counts` counts, for many ways: bucket (of the word) and list, its sorted numbers and how often each stands there.

    A list has the steps from one number to the next and the counts, each byte of them on end, so that it is short in the shuffle."""
    ways = len(ALPHABET) ** step

    def lists(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        bucket = spread(key // (2 * ways)) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        by = np.r_[key[:1], np.diff(key)]
        by[first] = key[first]
        rows = np.concatenate([big_endian(by, WIDE), big_endian(n, NUMBER)], axis=1)
        found = [rows[x:y].T.tobytes() for x, y in zip(first, [*first[1:], len(key)], strict=True)]
        return pa.record_batch([pa.array(bucket[first].astype(np.int32)), pa.array(found, pa.binary())], ["bucket", "list"])

    held, size = [], 0
    for key in way_keys(batches, k, step, allowed):
        held.append(key)
        size += len(key)
        if size >= SORTED:
            yield lists(held)
            held, size = [], 0
    if size:
        yield lists(held)


def listed_ways(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The ways (root, way, n_a, n_b) of `way_lists`, whose buckets stand on end: each once for each side, the ways of a word together."""
    keys: list[np.ndarray] = []
    n: list[np.ndarray] = []
    now, size = None, 0
    for batch in batches:
        for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and keys:
                yield from ways_in(*summed(keys, n), step)
                keys, n, size = [], [], 0
            now = bucket
            planes = np.frombuffer(text.as_buffer(), np.uint8).reshape(WIDE + NUMBER, -1).astype(np.int64)
            keys.append(np.cumsum(sum(planes[i] << 8 * (WIDE - 1 - i) for i in range(WIDE))))
            n.append(sum(planes[WIDE + i] << 8 * (NUMBER - 1 - i) for i in range(NUMBER)))
            size += len(n[-1])
            if size >= 2 * SORTED:
                # A word has so many ways at most, however often it stands there.
                one = summed(keys, n)
                keys, n, size = [one[0]], [one[1]], 0
    if keys:
        yield from ways_in(*summed(keys, n), step)


def way_places(batches: Iterator[pa.RecordBatch], k: int, step: int, allowed: np.ndarray | None, words: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The places that `way_counts` counts: is_a, seq_id, ends, root, way, rest (the letters before the way). words: a filter
    of ways; some others pass it."""
    ways = len(ALPHABET) ** step
    for whole in batches:
        for batch in slices(whole, 2, LOOKED) if whole.num_rows else ():
            of, ends, code, digits, at = ends_of(batch, k, step, allowed)
            way = six(digits, at, step)
            if words is not None:
                spot = spread(code * ways + way)
                there = np.flatnonzero(words[spot >> 6] >> (spot & 63) & 1)
                of, ends, code, way, at = of[there], ends[there], code[there], way[there], at[there]
            rows = pa.array(of)
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ends.astype(np.int32)), pa.array(code), pa.array(way), pa.array(six(digits, at - step, REST))], ["is_a", "seq_id", "ends", "root", "way", "rest"])


def way_marks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Where ways (root, way) are marked in a filter: at (a whole number of it), bit."""
    for batch in batches:
        root, way = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        spot = spread(root * len(ALPHABET) ** step + way)
        yield pa.record_batch([pa.array(spot >> 6), pa.array(spot & 63)], ["at", "bit"])


def ways_on(batches: Iterator[pa.RecordBatch], k: int, step: int) -> Iterator[pa.RecordBatch]:
    """is_a, seq_id, ends, root with the way and the rest before the word of k letters that ends there, from the read (the last column)."""
    for whole in batches:
        for batch in slices(whole, 4, LOOKED) if whole.num_rows else ():
            data, at = flat(batch.column(4))
            size, gap = np.diff(at), step + REST
            digits = np.zeros(at[-1] - at[0] + gap * len(size), np.uint8)
            digits[np.arange(at[-1] - at[0]) + gap * np.repeat(np.arange(1, len(size) + 1), size)] = DIGIT[data[at[0] : at[-1]]]
            before = at[:-1] - at[0] + gap * np.arange(1, len(size) + 1) + batch.column(2).to_numpy(zero_copy_only=False) - k - 1
            yield pa.record_batch([*batch.columns[:4], pa.array(six(digits, before, step)), pa.array(six(digits, before - step, REST))], ["is_a", "seq_id", "ends", "root", "way", "rest"])
