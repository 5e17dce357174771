"""An adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

Each block is coded by itself from a reset model. Its ids are cut into STRIPES even stripes, each with a coder of its own
over the block's one model, so that a step codes one id in every stripe of every block of a batch (the lanes of the same
arrays). The model mixes three predictions of the next id. The order-2 and order-1 contexts each remember
the id that followed them last, with a confidence; how often guesses of that confidence held so far gives their share of
the range. The rest of the range goes to the order-0 frequencies of the ids seen so far, with an escape to all ids.
Contexts and hit rates learn after every SEGMENT steps, frequencies at fixed places. The coders have a 64-bit low end and
range and write 16-bit words; a carry goes into the words already written. A block's bytes are the lengths of its stripes
in words (u32 each), then the words.
"""

from __future__ import annotations

import numpy as np

STRIPES = 64
#: Blocks side by side.
LANES = 64
SLOTS = 1 << 11
TOTAL_BITS = 36
TOTAL = 1 << TOTAL_BITS
QUANTA_BITS = 14
QUANTA = 1 << QUANTA_BITS
RANKS = QUANTA // 2
LEVEL_BITS = 3
LEVELS = 1 << LEVEL_BITS
SEGMENT = 8
#: Steps at which the frequencies are taken anew.
REFRESH = (16, 64, 256)
#: The escape has at least LEAST quanta, and a quantum at least 2 ** (TOTAL_BITS - QUANTA_BITS - 10) units: enough for so many ids.
LEAST = 64
MOST_IDS = LEAST << TOTAL_BITS - QUANTA_BITS - 10
U = np.uint64
#: A range is at least TOP between steps, so a step takes three words at most.
TOP = U(1 << 48)
SHIFT16, SHIFT48, TOTAL_SHIFT = U(16), U(48), U(TOTAL_BITS)
#: Hit rates to begin with, by confidence, as hits in 32 guesses.
PRIOR = (1, 8, 14, 18, 22, 25, 27, 29)


def refreshes(step: int) -> bool:
    return step in REFRESH or step > REFRESH[-1] and step % 512 == 0


class Model:
    """The state of all blocks; encoder and decoder make the same calls in the same order. `block` is each lane's block."""

    def __init__(self, block: np.ndarray, blocks: int, vocabulary: int) -> None:
        if vocabulary > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} different ids")
        self.v, self.blocks = vocabulary, blocks
        # Of the order-2 contexts, then of order 1: a context's guess, and its confidence in the low bits.
        self.guess = np.full(2 * blocks * SLOTS, vocabulary << LEVEL_BITS, np.int32)
        self.tried = np.full(2 * blocks * LEVELS, 32)
        self.held = np.tile(np.array(PRIOR), 2 * blocks)
        self.block = block
        both = np.stack([block, block + blocks])
        self.base, self.level = both * SLOTS, both * LEVELS
        self.slot_row, self.rank_row, self.id_row = block * QUANTA, block * (RANKS + 2), block * vocabulary
        # Order 0: rank 0 is the escape; ranks of seen ids; where each rank's quanta begin; the rank of each quantum.
        self.rank_of_id = np.zeros(blocks * vocabulary, np.uint16)
        self.ranked = np.zeros(0, np.int64)  # where it isn't 0
        self.begin = np.zeros((blocks, RANKS + 2), np.int32)
        self.begin[:, 1:] = QUANTA
        self.id_of_rank = np.zeros((blocks, RANKS + 2), np.int32)
        self.rank_of_quantum = np.zeros((blocks, QUANTA), np.uint16)
        self.weigh()

    def weigh(self) -> None:
        """Shares of the range by level: at most 31/32 of the rest, in 2**-16 parts."""
        self.share = ((self.held << 16) // self.tried * 31 >> 5).astype(U)

    def look(self, m: int, p1: np.ndarray, p2: np.ndarray):
        """Slots, what they hold, levels and guesses of both contexts in the first m lanes, and the ends of their shares; lanes stand last."""
        base, row = (a[:, :m].reshape(2, *[1] * (p1.ndim - 1), m) for a in (self.base, self.level))
        # The products may wrap: only low bits are taken.
        h = p1 * 40503
        slot = np.empty((2, *h.shape), np.int64)
        np.right_shift(h, 4, out=slot[1])
        h += p2 * 60493
        np.right_shift(h, 5, out=slot[0])
        slot &= SLOTS - 1
        slot += base
        c = self.guess[slot]
        level, g = (c & LEVELS - 1) + row, c >> LEVEL_BITS
        share = self.share[level]
        w2 = share[0] << U(TOTAL_BITS - 16)
        both = (TOTAL - w2 >> SHIFT16) * share[1]
        both *= g[0] != g[1]
        both += w2
        return (slot, c, level, g), w2, both

    def learn(self, where, ids: np.ndarray) -> None:
        """From the ids of a segment; where a slot occurs several times in it, the last one stays."""
        slot, c, level, g = where
        hit = g == ids
        level <<= 1
        level |= hit
        counts = np.bincount(level.ravel(), minlength=2 * len(self.tried)).reshape(-1, 2)
        self.tried += counts.sum(1)
        self.held += counts[:, 1]
        sure = c & LEVELS - 1
        self.guess[slot] = np.where(hit, c + (sure < LEVELS - 1), np.where(sure > 1, c - (sure + 1 >> 1), ids << LEVEL_BITS))
        self.weigh()

    def refresh(self, seen: np.ndarray) -> None:
        """Order-0 frequencies from all ids so far (step by lane) of every block that goes on, all blocks at once."""
        # LANES * MOST_IDS is below 2**31.
        key, counts = np.unique((self.block[: seen.shape[1]].astype(np.int32) * np.int32(self.v) + seen).ravel(), return_counts=True)
        block, ids = np.divmod(key, self.v)
        alive = np.unique(block)
        first = np.searchsorted(block, alive)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) + 1
        few = rank <= RANKS
        block, ids, counts, rank = block[few], ids[few], counts[few], rank[few]
        kinds = np.bincount(block, minlength=self.blocks)[alive]
        n = np.bincount(self.block[: seen.shape[1]], minlength=self.blocks)[alive] * len(seen)
        room = np.maximum(0, QUANTA - kinds - np.maximum(LEAST, QUANTA * kinds // (2 * n) // 8))
        size = np.diff(np.append(np.searchsorted(block, alive), len(block)))
        quanta = 1 + counts * np.repeat(room, size) // np.repeat(n, size)
        end = np.cumsum(quanta)
        total = np.add.reduceat(quanta, np.searchsorted(block, alive))
        escape = QUANTA - total
        end += np.repeat(escape - (np.cumsum(total) - total), size)
        self.begin[alive, 0] = 0
        self.begin[alive, 1] = escape
        self.begin[block, rank + 1] = end
        self.id_of_rank[block, rank] = ids
        # An id may lose its rank: to others beyond RANKS, or with a stripe that is at its end.
        self.rank_of_id[self.ranked] = 0
        self.ranked = block * self.v + ids
        self.rank_of_id[self.ranked] = rank
        # Escape, then each rank, block by block.
        at = np.searchsorted(block, alive)
        ranks = np.insert(rank, at, 0).astype(np.uint16)
        self.rank_of_quantum[alive] = np.repeat(ranks, np.insert(quanta, at, escape)).reshape(len(alive), QUANTA)


def carry(words: np.ndarray, place: np.ndarray) -> None:
    """Adds one to the words at different lanes' places, and to the words before those that were at their most."""
    while len(place):
        words[place] += 1
        place = place[words[place] == 0] - 1


def batches(sizes: list[int]) -> list[list[int]]:
    """Blocks by falling size, LANES at a time."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    return [order[a : a + LANES] for a in range(0, len(order), LANES)]


def stripes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes of blocks of these sizes by falling length: each one's block, first place in the block, and length."""
    step = -(-sizes // STRIPES)
    first = np.arange(STRIPES)[None, :] * step[:, None]
    length = np.clip(sizes[:, None] - first, 0, step[:, None]).ravel()
    by = np.argsort(-length, kind="stable")
    return by // STRIPES, first.ravel()[by], length[by]


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block's coded bytes. Blocks are any lengths; ids are below `vocabulary`."""
    out: list[bytes] = [b""] * len(blocks)
    for lanes in batches([len(b) for b in blocks]):
        for k, coded in zip(lanes, _encode([blocks[k] for k in lanes], vocabulary), strict=True):
            out[k] = coded
    return out


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    block, first, length = stripes(np.array([len(b) for b in blocks]))
    n = len(block)
    steps = -(-int(length[0]) // SEGMENT) * SEGMENT
    rows = np.zeros((n, steps), np.int32)
    for k, (b, a, size) in enumerate(zip(block.tolist(), first.tolist(), length.tolist(), strict=True)):
        rows[k, :size] = blocks[b][a : a + size]
    ids = np.zeros((steps + 2, n), np.int32)  # two ids of context stand before the first
    ids[2:] = rows.T
    model = Model(block, len(blocks), vocabulary)
    low, size = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    row = 3 * steps + 16
    words, used = np.zeros(n * row, np.uint16), np.arange(n) * row
    begin, kinds = model.begin.reshape(-1), U(vocabulary)
    for t in range(0, steps, SEGMENT):
        m = int((length > t).sum())
        if refreshes(t):
            model.refresh(ids[2 : t + 2, :m])
        x = ids[t + 2 : t + SEGMENT + 2, :m]
        where, w2, both = model.look(m, ids[t + 1 : t + SEGMENT + 1, :m], ids[t : t + SEGMENT, :m])
        g2, g1 = where[3]
        unit = TOTAL - both >> U(QUANTA_BITS)
        rank = model.rank_of_id[model.id_row[:m] + x]
        cell = model.rank_row[:m] + rank
        lower = begin[cell]
        cell += 1
        start, span = lower.astype(U), (begin[cell] - lower).astype(U)
        start *= unit
        start += both
        span *= unit
        escaped = np.flatnonzero(rank == 0)
        each = span.ravel()[escaped] // kinds
        span.ravel()[escaped] = each
        start.ravel()[escaped] += x.ravel()[escaped].astype(U) * each
        hit = g1 == x
        np.copyto(start, w2, where=hit)
        np.copyto(span, both - w2, where=hit)
        hit = g2 == x
        np.copyto(start, 0, where=hit)
        np.copyto(span, w2, where=hit)
        lo, sz, to = low[:m], size[:m], used[:m]
        for s in range(SEGMENT):
            r = sz >> TOTAL_SHIFT
            np.multiply(r, span[s], out=sz)
            r *= start[s]
            lo += r
            over = lo < r
            if over.any():
                carry(words, to[over] - 1)
            # Every lane writes a word, and those whose range is small keep it. Few need more than one.
            words[to] = lo >> SHIFT48
            small = sz < TOP
            to += small
            shift = small * SHIFT16
            lo <<= shift
            sz <<= shift
            at = (sz < TOP).nonzero()[0]
            while len(at):
                place = to[at]
                words[place] = lo[at] >> SHIFT48
                to[at] = place + 1
                lo[at] <<= SHIFT16
                sz[at] <<= SHIFT16
                at = at[sz[at] < TOP]
        model.learn(where, x)
    for _ in range(4):
        words[used] = low >> SHIFT48
        used += 1
        low <<= SHIFT16
    used -= np.arange(n) * row
    place = np.empty(n, np.int64)
    place[np.lexsort((first, block))] = np.arange(n)
    coded: list[list[bytes]] = [[] for _ in blocks]
    sizes: list[list[int]] = [[] for _ in blocks]
    for k in np.argsort(place).tolist():
        coded[block[k]].append(words[k * row : k * row + used[k]].astype("<u2").tobytes())
        sizes[block[k]].append(int(used[k]))
    return [np.array(s, "<u4").tobytes() + b"".join(c) for s, c in zip(sizes, coded, strict=True)]


def decode(coded: list[bytes], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block; bytes that are no block of that size give a ValueError or other ids."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
    for lanes in batches(sizes):
        for k, ids in zip(lanes, _decode([coded[k] for k in lanes], np.array([sizes[k] for k in lanes]), vocabulary), strict=True):
            out[k] = ids
    return out


def _decode(coded: list[bytes], sizes: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    block, first, length = stripes(sizes)
    n = len(block)
    steps = -(-int(length[0]) // SEGMENT) * SEGMENT
    row = 3 * steps + 16
    words = np.zeros(n * row, np.uint16)
    order = np.lexsort((first, block))  # the stripes as they stand in the blocks' bytes
    for b, c in enumerate(coded):
        lanes = order[b * STRIPES : (b + 1) * STRIPES].tolist()
        if len(c) < 4 * STRIPES:
            raise ValueError("a block's coded ids are cut off")
        used = np.frombuffer(c, "<u4", STRIPES).astype(np.int64)
        if len(c) != 4 * STRIPES + 2 * int(used.sum()) or int(used.max()) > row:
            raise ValueError("a block's coded ids are cut off")
        flat, a = np.frombuffer(c, "<u2", offset=4 * STRIPES), 0
        for k, u in zip(lanes, used.tolist(), strict=True):
            words[k * row : k * row + u] = flat[a : a + u]
            a += u
    model = Model(block, len(coded), vocabulary)
    # The coder's low end is taken off the code.
    size, code = np.full(n, (1 << 64) - 1, U), np.zeros(n, U)
    used = np.arange(n) * row
    for _ in range(4):
        code = code << SHIFT16 | words[used]
        used += 1
    ids = np.zeros((steps + 2, n), np.int32)
    quantum, id_of, begin = model.rank_of_quantum.reshape(-1), model.id_of_rank.reshape(-1), model.begin.reshape(-1)
    kinds = U(vocabulary)
    for t in range(0, steps, SEGMENT):
        m = int((length > t).sum())
        if refreshes(t):
            model.refresh(ids[2 : t + 2, :m])
        sz, co, to = size[:m], code[:m], used[:m]
        seen = tuple(np.empty((2, SEGMENT, m), kind) for kind in (np.int64, np.int32, np.int64, np.int32))
        for s in range(SEGMENT):
            where, w2, both = model.look(m, ids[t + s + 1, :m], ids[t + s, :m])
            for all_, one in zip(seen, where, strict=True):
                all_[:, s] = one
            g2, g1 = where[3]
            r = sz >> TOTAL_SHIFT
            end2, end1 = r * w2, r * both
            at = (co >= end1).nonzero()[0]
            rest = co[at] - end1[at]
            after2 = co >= end2
            x = ids[t + s + 2, :m]
            x[:] = np.where(after2, g1, g2)
            np.subtract(end1, end2, out=end1)
            sz[:] = np.where(after2, end1, end2)
            end2 *= after2
            co -= end2
            if len(at):
                scale = r[at]
                unit = TOTAL - both[at] >> U(QUANTA_BITS)
                u = scale * unit
                rank = quantum[model.slot_row[at] + np.minimum(rest // u, QUANTA - 1).view(np.int64)]
                cell = model.rank_row[at] + rank
                lower = begin[cell]
                y = id_of[cell]
                cell += 1
                wide = (begin[cell] - lower).astype(U)
                rest -= lower.astype(U) * u
                out = (rank == 0).nonzero()[0]
                u *= wide
                if len(out):
                    each = wide[out] * unit[out] // kinds * scale[out]
                    found = np.minimum(rest[out] // each, vocabulary - 1)
                    y[out] = found
                    rest[out] -= found * each
                    u[out] = each
                x[at], co[at], sz[at] = y, rest, u
            small = sz < TOP
            shift = small * SHIFT16
            co <<= shift
            co |= words[to] * small
            sz <<= shift
            to += small
            at = (sz < TOP).nonzero()[0]
            while len(at):
                place = to[at]
                co[at] = co[at] << SHIFT16 | words[place]
                to[at] = place + 1
                sz[at] <<= SHIFT16
                at = at[sz[at] < TOP]
        model.learn(seen, ids[t + 2 : t + SEGMENT + 2, :m])
    out = [np.empty(k, np.int64) for k in sizes.tolist()]
    rows = np.ascontiguousarray(ids[2:].T)
    for k, (b, a, size_) in enumerate(zip(block.tolist(), first.tolist(), length.tolist(), strict=True)):
        out[b][a : a + size_] = rows[k, :size_]
    return out
