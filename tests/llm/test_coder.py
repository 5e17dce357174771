import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import queries, range_coder, suffix_dedup, token_output

blocks = st.lists(st.lists(st.integers(0, 299), max_size=300), min_size=1, max_size=6)


@settings(max_examples=25, deadline=None)
@given(blocks)
def test_round_trip(lists):
    made = [np.array(x, np.int64) for x in lists]
    coded = range_coder.encode(made, 300)
    for x, y in zip(made, range_coder.decode(coded, [len(x) for x in made], 300), strict=True):
        assert x.tolist() == y.tolist()


def test_blocks_are_independent_and_small():
    r = np.random.default_rng(0)
    ids = np.minimum(r.zipf(1.4, 20_000), 49_407)
    many = range_coder.encode([ids, ids[:100], ids], 49_408)
    assert many[0] == many[2] == range_coder.encode([ids], 49_408)[0]
    assert len(many[0]) < 2 * len(ids) + 8 * range_coder.STRIPES


def test_blocks_of_all_sizes_are_decoded_beside_others():
    """Stripes that end early take ids' ranks with them; a block is decoded in other company than it was coded in."""
    r = np.random.default_rng(8)
    made = [r.integers(0, 40 if k % 2 else 9000, 37 * k) for k in range(90)]
    coded = range_coder.encode(made, 9000)
    for part in (slice(None), slice(3, 80, 7), slice(1, 2)):
        for x, y in zip(made[part], range_coder.decode(coded[part], [len(x) for x in made[part]], 9000), strict=True):
            assert (x == y).all()
    # More kinds than ranks.
    ids = r.permutation(16_384)
    assert (range_coder.decode(range_coder.encode([ids], 16_384), [len(ids)], 16_384)[0] == ids).all()


def test_broken_blocks_are_found():
    """Any changed byte and any cut raises ValueError, whatever it hits: head, pieces or coded ids."""
    w = token_output.Writer(0, 300)
    w.add(7, np.arange(50, dtype=np.uint32))
    w.add(None, np.arange(250, dtype=np.uint32))
    payload = next(w.rows(True)).column("payload")[0].as_py()
    assert token_output.opened([payload])[0][0].tolist() == [*range(50), *range(250)]
    for k in range(len(payload)):
        for bad in (payload[:k], payload[:k] + bytes([payload[k] ^ 1]) + payload[k + 1 :]):
            with pytest.raises(ValueError):
                token_output.opened([bad])


def test_cut_off_ids_are_found():
    coded = range_coder.encode([np.arange(100)], 300)[0]
    for k in range(len(coded)):
        with pytest.raises(ValueError):
            range_coder.decode([coded[:k]], [100], 300)
    with pytest.raises(ValueError):
        range_coder.encode([np.arange(100)], range_coder.MOST_IDS + 1)


@pytest.mark.parametrize("kinds", [2, 50, 40_000, 260_000])
def test_long_blocks(kinds):
    """Blocks of several refreshes, alone and side by side, with ids of every frequency."""
    r = np.random.default_rng(kinds)
    made = [r.integers(0, kinds, n) for n in (16_384, 16_384, 9_001, 1, 0, 31)] + [np.repeat(r.integers(0, kinds, 3), 5000), np.minimum(r.zipf(1.2, 16_384), kinds - 1)]
    coded = range_coder.encode(made, kinds)
    assert coded[0] == range_coder.encode(made[:1], kinds)[0]
    for x, y in zip(made, range_coder.decode(coded, [len(x) for x in made], kinds), strict=True):
        assert (x == y).all()


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(c % 3 + 97 for c in b)))
def test_suffix_array_and_prefixes(text):
    x = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(x)
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    want = [0]
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        want.append(min(n, 100))
    assert suffix_dedup.kasai(x, order, 100).tolist() == want


def test_carries_go_through_full_words():
    words = np.array([1, 0xFFFF, 0xFFFF, 7, 0, 8, 0xFFFF], np.uint16)
    range_coder.carry(words, np.array([2, 4, 6]))
    assert words.tolist() == [2, 0, 0, 7, 1, 9, 0]


ODD = ["'s", "'re", "'ll", "'l", "'", "''s", "!'t", " ", "\t", "\x85", "\xa0", "\x1c", "\0", "a", "a\0", "tat", "É", "ß", "Ÿ", "ſ", "İ", "²", "¼", "51", ".", "!!", "x" * 23, "x" * 24, "é" * 30, "<|", "ƀ", "e\u0301", "日本"]


@pytest.mark.parametrize("case", ["kept", "few kept", "equal hashes", "other beginnings"])
def test_ids_of_odd_texts_equal_the_librarys(case, monkeypatch):
    if case == "few kept":
        monkeypatch.setattr(token_output, "KEPT_WORDS", 5)
    if case == "equal hashes":
        monkeypatch.setattr(token_output, "MIX", np.zeros(3, np.uint64))
    if case == "other beginnings":
        monkeypatch.setattr(token_output, "BEFORE_MODEL", ())
    r = random.Random(5)
    texts = ["".join(r.choices(ODD[: r.choice((11, 20, len(ODD)))], k=r.randrange(12))) for _ in range(1500)]
    encode = token_output.Encoder(queries.vocabulary(), True)
    assert encode.latin and (encode.on_parts is encode.tk) == (case == "other beginnings")
    want = [e.ids for e in encode.tk.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 300):
        assert [x.tolist() for x in encode(texts[a : a + 300])] == want[a : a + 300]
    assert [x.tolist() for x in encode(["", " "])] == [[], []] and encode([]) == []


def test_portions_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_output, "TEXT_BYTES", 10)
    for sizes in ([], [0], [50], [3, 3, 3, 3, 50, 0, 0, 12, 1], [0, 0, 9, 1, 9, 1]):
        texts = [c * n for c, n in zip("abcdefghi", sizes, strict=False)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        parts = [p.column("text").to_pylist() for p in token_output.portions(batch)]
        assert sum(parts, []) == texts and all(len("".join(p[1:])) < 20 for p in parts)


def test_an_id_costs_little():
    """Tokenising, encoding and decoding, against the library's time for the same whole texts; made-up words, few of which are known."""
    r = random.Random(3)
    syllables = ["th", "ou", "re", "ti", "on", "an", "en", "ed", "sha", "ble"]
    texts = [" ".join("".join(r.choices(syllables, k=r.choice((1, 1, 2, 3, 4, 5)))) for _ in range(400)) + "." for _ in range(3000)]

    def seconds(f):
        best = []
        for _ in range(3):
            began = time.process_time()
            out = f()
            best.append(time.process_time() - began)
        return min(best), out

    def ours():
        encode = token_output.Encoder(queries.vocabulary(), True)
        ids = np.concatenate(encode(texts))
        blocks = [ids[a : a + token_output.BLOCK] for a in range(0, len(ids), token_output.BLOCK)]
        coded = range_coder.encode(blocks, len(encode.ends))
        back = range_coder.decode(coded, [len(b) for b in blocks], len(encode.ends))
        assert (np.concatenate(back) == ids).all()
        return ids

    tk = token_output.tokenizer(queries.vocabulary())
    theirs, want = seconds(lambda: [i for e in tk.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids])
    took, ids = seconds(ours)
    assert ids.tolist() == want
    print(took, theirs, took / theirs)
    assert took < 0.6 * theirs
