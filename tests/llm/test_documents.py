"""Operators on documents against brute force, on a table with every awkward case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontamination, license_scan, mixing, near_dedup, pii, quality_model, quality_rules, queries, suffix_dedup, token_output

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in a quiet cave by the sea and nobody hears their songs at night"
LONG = " ".join(f"word{i % 977} x{i % 13}" for i in range(30_000))
ROWS = [
    (None, "a document without a number " + PASSAGE),
    (0, None),
    (1, ""),
    (2, " \t\n "),
    (3, "one"),
    (4, "ONE"),
    (5, PASSAGE),
    (6, PASSAGE.upper()),
    (7, PASSAGE + " again"),
    (7, PASSAGE + " again"),
    (7, "another text of the same number " + PASSAGE),
    (8, "Mail a.b+c@example.com, x@y and q@w.e-r.t; call +1 (212) 555-0100 or 10.0.0.255 300.1.1.1 1.2.3.4.5.6.7.8"),
    (9, "card 4111 1111 1111 1111 and 4111111111111112, token = \"0123456789abcdef0123456789abcdef\" é+1 555 1234567 9"),
    (10, "Licensed under the Apache License, Version 2.0. MIT-License! gnu General public LICENSE cc by cc by"),
    (11, "All rights reserved."),
    (12, LONG),
    (13, LONG + " tail"),
    (14, "aaaa " * 400),
    (15, "Ünïcödé ß Ω   text 😀 " * 20),
    (16, "line\nline\n\n \nother\nline\n"),
    (17, "a b c a b c x y z"),
    (18, "prefix " + LONG[5000:5400] + " suffix"),
    (19, "zero\x00byte \x1c sep \x85 nel"),
]


def table(spark, rows=ROWS):
    """doc_id and text, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "matches", "n", "sig", "o", "sha", "label", "words", "rate", "copies", "value", "tokens", "quality", "domain", "lang", "shard", "spans")})


def ids(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, size):
    got = near_dedup.classify(table(spark), size).collect()
    sets = [shingle_set(t, size) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = []
    for i, (d, _) in enumerate(ROWS):
        members = [ROWS[j][0] for j in range(len(ROWS)) if group[j] == group[i] and ROWS[j][0] is not None]
        name = min(members) if members and sets[i] else d
        want.append((d, len(sets[i]), name, d == name))
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def components(rows, size):
    """Brute force: doc_id -> least doc_id reachable."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {k: root(k) for k in range(len(rows))}


def edited_copies(words, copies, most):
    """Copies of one text with 0 to `most` words replaced; half of the edits are copied as well, as far as they go."""
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(copies):
        w = list(base)
        for e in range(k % (most + 1)):
            w[(7 * (k if k % 2 else k % 16) + 11 * e) % words] = f"e{k if k % 2 else k % 16}_{e}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("small", "block", "rounds", "words", "most"), [(12, 1024, 2, 60, 8), (12, 64, 2, 60, 8), (4, 64, 1, 200, 40), (4, 64, 2, 200, 40), (2, 32, 3, 300, 90), (12, 1024, 0, 60, 8)])
def test_near_dedup_of_many_edited_copies(spark, monkeypatch, small, block, rounds, words, most):
    """Lists longer than SMALL and groups longer than BLOCK, whose members are not all linked with a hub; sets on both sides of 100 shingles."""
    if not rounds:  # no list is long
        small = 10_000
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ROUNDS", max(1, rounds))
    rows = edited_copies(words, 400, most)
    got = {r[0]: r[2] for r in near_dedup.classify(table(spark, rows), 2).collect()}
    assert got == components(rows, 2)


def test_near_dedup_compares_long_texts_in_smaller_blocks(spark, monkeypatch):
    """A block is bounded by the values of its full sets, not by its rows alone."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "VALUES", 4000, raising=False)
    compared, blocks = near_dedup.compared, spark.sparkContext.accumulator(0)

    def bounded(group):
        blocks.add(1)
        if group["n"].sum() > 3 * 4000:  # two sides of a block, dealt by hash
            raise ValueError(f"a block of {group['n'].sum()} values")
        return compared(group)

    monkeypatch.setattr(near_dedup, "compared", bounded)
    rows = edited_copies(200, 400, 40)
    got = {r[0]: r[2] for r in near_dedup.classify(table(spark, rows), 2).collect()}
    assert got == components(rows, 2) and blocks.value > 1


@pytest.mark.parametrize("size", range(1, 7))
def test_shingles_of_few_words(size):
    """Batches of 0 to 6 words in all, in every split into texts."""
    for total in range(7):
        words = [f"w{k}" for k in range(total)]
        for cut in range(total + 1):
            texts = [" ".join(words[:cut]), " ".join(words[cut:])]
            got = near_dedup.shingles([t.encode() for t in texts], size)
            assert [len(x) for x in got] == [len(shingle_set(t, size)) for t in texts]
            alone = [near_dedup.shingles([t.encode()], size)[0].tolist() for t in texts]
            assert [x.tolist() for x in got] == alone


def test_representatives_of_texts_of_few_words(spark):
    rows = [(1, "a b c"), (2, "a b"), (3, "a b c"), (4, "a")]
    kept = near_dedup.representatives(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_columns_of_any_name_are_carried(spark):
    odd = ("a.b", "__copy", "__n", "__row", "__text", "box", "at", "times", "score", "matches", "none", "c2", "id", "copies")
    docs = spark.createDataFrame([(k, f"some words of text {k // 2}") for k in (0, 1, 2, 2)], "doc_id bigint, text string").select("doc_id", *[F.lit(f"{c}!").alias(c) for c in odd[:7]], "text", *[F.lit(f"{c}!").alias(c) for c in odd[7:]])
    labelled = spark.createDataFrame([(0, "en")], "doc_id bigint, domain string")
    items = spark.createDataFrame([(1, "an item that no text has in it at all")], "item_id bigint, text string")
    for out, n in ((near_dedup.representatives(docs), 2), (mixing.mixed(docs, labelled, {"en": 1.0}, least=1.0), 4), (decontamination.clean(docs, items), 4)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == n and all(r[c] == f"{c}!" for r in rows for c in odd)


def test_representatives(spark):
    kept = near_dedup.representatives(table(spark))
    assert kept.columns == table(spark).columns
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(got) == len(set(got)) and {0, 1, 2, 3, 5, 12} <= set(got) and 6 not in got and 13 not in got


def removed(rows):
    order = sorted({((-(1 << 63) if d is None else d), hashlib.sha256((t or "").encode()).digest(), t or "") for d, t in rows})
    seen, out = set(), {}
    for o, _, t in order:
        b = t.encode()
        own = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                own[k : k + 100] = b"\1" * 100
            else:
                seen.add(b[k : k + 100])
        out[o, t] = own
    return out


@pytest.mark.parametrize(("shard", "range_", "hot"), [(1 << 20, 1 << 24, 1 << 12), (60_000, 1 << 24, 1 << 12), (5_000, 40_000, 2), (1_000, 5_000, 1)])
def test_suffix_dedup(spark, monkeypatch, shard, range_, hot):
    """With small shards the long texts are cut into pieces, with `hot` small most anchors are dealt over several ranges."""
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "RANGE", range_)
    line = "a very common line of a good many words which stands in all these documents but never beside the same others"
    rows = [*ROWS, *((100 + k, f"{'x' * (k % 7)}{k * 7919} begins {line} and {k * 104_729} ends {'y' * 50 if k % 5 else ''}") for k in range(60))]
    got = suffix_dedup.digest(suffix_dedup.remove(table(spark, rows), hot)).collect()
    own = removed(rows)
    want = []
    for d, t in rows:
        b, gone = (t or "").encode(), own[-(1 << 63) if d is None else d, t or ""]
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_suffix_dedup_tells_equal_keys_apart(monkeypatch):
    """With one hash for all strings the bytes decide."""
    monkeypatch.setattr(suffix_dedup, "rolling", lambda flat, size: np.full(max(0, len(flat) - size + 1), 7, np.uint64))
    r = np.random.default_rng(2)
    text = [r.integers(97, 99, 400).astype(np.uint8) for _ in range(3)]
    text[1][:150] = text[0][200:350]
    text[2] = np.concatenate([text[1][20:300], text[0][:120]])
    starts = [np.arange(301)] * 3
    group = pd.DataFrame({"shard": [5, 9, 7], "bucket": 0, "blob": [suffix_dedup.stretches(text[k], starts[k]) for k in (0, 2, 1)]})
    out = suffix_dedup.held_before(group)
    seen, want = set(), {}
    for shard, k in ((5, 0), (7, 1), (9, 2)):
        strings = [text[k][s : s + 100].tobytes() for s in starts[k]]
        want[shard] = [s in seen for s in strings]
        seen |= set(strings)
    for shard, blob in zip(out["shard"], out["blob"], strict=True):
        assert np.unpackbits(np.frombuffer(blob, np.uint8), count=301).astype(bool).tolist() == want[shard]


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for n, letters in ((1, 2), (7, 1), (300, 2), (2000, 4), (1500, 1)):
        text = r.integers(97, 97 + letters, n).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda k: raw[k:])
        want = [0] + [next((i for i, (x, y) in enumerate(zip(raw[a:], raw[b:], strict=False)) if x != y), min(n - a, n - b)) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
        assert suffix_dedup.kasai(text, order, 100).tolist() == [min(100, x) for x in want]


def test_license_scan(spark):
    got = license_scan.digest(license_scan.find(table(spark))).collect()
    for (d, t), r in zip(ROWS, got, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        names = ",".join(sorted({x for _, x in at}))
        assert (r.doc_id, r.n_words, r.n_base, r.base_labels) == (d, len(w), len(at), names)
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert {r.doc_id: r.labels for r in got}[11] == "proprietary"


def test_license_templates_are_found_with_edits():
    scan = license_scan.scanner().scan
    for label, text in license_scan.NOTICES:
        found = scan(license_scan.words(f"some words before {text} and after"))[1]
        assert any(x == label and c == 1 for x, _, _, c in found), label
    words = license_scan.NOTICES[6][1].split()
    words[10] = "gratis"
    assert "mit" in {x[0] for x in scan(license_scan.words(" ".join(words)))[1]}


def base_spans(text):
    out = []
    at = 0
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(patterns).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)], at


def test_pii(spark):
    got = pii.digest(pii.find(table(spark))).collect()
    for (d, t), r in zip(ROWS, got, strict=True):
        want = base_spans(t or "")[0]
        assert r.doc_id == d and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
    assert "secret:" in {r.doc_id: r.spans for r in got}[9]


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@a.b", "a@b", "x@-.-", "aa@b.c_d@e.f", "1.2.3.4.5", "0001.2.3.256 1.2.3.4", "1-2 3-4", "+1 2", "+" * 50, "a" * 3000 + "@" * 5, "9" * 5000])
def test_pii_base_patterns(text):
    assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == base_spans(text)[0]


def test_field_on_unseen_sentences():
    field = pii.trained()
    right = total = found = 0
    for tokens, spans in pii.made_sentences(99, 120):
        got = set(field.decode(tokens))
        right += len(got & set(spans))
        total += len(spans)
        found += len(got)
    assert right / total > 0.95 and right / found > 0.95
    assert pii.redact("call +1 212 5550100 now", [(5, 19, "phone")]) == "call [phone] now"


def segmentations(n, most):
    """All ways to cut n tokens into segments of at most `most`."""
    if not n:
        return [[]]
    return [[*head, (n - k, n)] for k in range(1, min(n, most) + 1) for head in segmentations(n - k, most)]


def test_field_decodes_the_best_of_all_segmentations():
    field = pii.trained()
    for tokens, _ in pii.made_sentences(5, 40):
        tokens = tokens[-6:]
        score = lambda i, j, field=field, tokens=tokens: max(((float(field.w[ids].sum()), kind) for kind, ids in field.kinds(tokens, i, j)), default=(-np.inf, ""))
        best = max(sum(score(i, j)[0] for i, j in cut) for cut in segmentations(len(tokens), pii.MAX_TOKENS))
        got = field.decode(tokens)
        inside = {p for i, j, _ in got for p in range(i, j)}
        own = sum(float(field.w[ids].sum()) for i, j, kind in got for k, ids in field.kinds(tokens, i, j) if k == kind)
        own += sum(float(field.w[ids].sum()) for p in range(len(tokens)) if p not in inside for k, ids in field.kinds(tokens, p, p + 1) if k == "text")
        assert abs(own - best) < 1e-6


def test_field_spans_do_not_depend_on_how_many_triggers_there_are():
    """Many entities on end are found like each one alone; a long token before a trigger isn't cut."""
    field = pii.trained()
    one = 'filler words here token = "0123456789abcdef0123456789abcdef" and more words after it. '
    alone = pii.field_spans(one, field)
    assert len(alone) == 1 and alone[0][2] == "secret"
    assert pii.field_spans(one * 300, field) == [(a + k * len(one), b + k * len(one), kind) for k in range(300) for a, b, kind in alone]
    dense = 'token = "0123456789abcdef0123456789abcdef" '
    assert len(pii.field_spans(dense * 500, field)) == 500
    long = "x" * 5000
    assert pii.field_spans(f"{long} {one}", field) == [(a + 5001, b + 5001, kind) for a, b, kind in alone]
    assert all(pii.field_spans(f"the key = {x} ends here", field) for x in ("A1B2C3D4E5F60718293A4B5C6D7E8F90", "x7Kp2mQ9vR4tW8zL3nB6"))


def test_quality_rules(spark):
    got = quality_rules.judge(table(spark)).collect()
    want = []
    for d, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        again = len({k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, len(w) < 50 or 100 * again > 50 * len(w)))
    assert collections.Counter(tuple(r)[:7] for r in got) == collections.Counter(want)
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_rules_pairs_beyond_the_packed_size(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 4)
    rows = [(k, " ".join(f"w{(i * (k + 3)) % (5 + k)}" for i in range(12 + k))) for k in range(12)]
    got = {r[0]: r.n_repeat_words for r in quality_rules.judge(table(spark, rows)).collect()}
    for k, t in rows:
        w = t.split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert got[k] == len({i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)})


def test_quality_rules_equal_keys_of_other_words(spark, monkeypatch):
    """With 4 bits of hash most windows share a key; only those of equal words count."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 60)
    rows = [(1, " ".join(f"w{i}" for i in range(200))), (2, " ".join(f"w{i}" for i in range(200)) + " w7 w8 w9")]
    assert {r[0]: r.n_repeat_words for r in quality_rules.judge(table(spark, rows)).collect()} == {1: 0, 2: 6}


def test_distribution_divergence(spark):
    clean = "the cat of the house and the dog in it is as old as a tree that stands for us to see with "
    junk = "".join(f"{c}|#{c}%%" for c in "qzxkvbjw") * 40
    rows = [(k, clean * 8) for k in range(20)] + [(99, " ".join(junk[i : i + 7] for i in range(0, 1400, 7)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("text", F.concat("text", F.expr("array_join(transform(sequence(1, 600), i -> concat(' n', i + doc_id * 1000)), '')")))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[0].kept and not got[0].base_failed
    assert got[99].char_distance > got[0].char_distance and got[99].word_distance > got[0].word_distance


def vocabulary():
    return queries.vocabulary()


def test_token_output(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK", 1000)
    token_output.write(table(spark), str(tmp_path / "b"), vocabulary())
    blocks = spark.read.parquet(str(tmp_path / "b"))
    got = sorted(tuple(r) for r in token_output.read(blocks).collect() if r.doc_id is not None)
    tk = Tokenizer.from_file(vocabulary())
    start, want = 0, []
    order = table(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t"))
    for d, t in map(tuple, order.collect()):
        import numpy as np

        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4")
        if d is not None:
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert blocks.groupBy("shard").count().count() >= 1


def test_tokens_of_words_equal_those_of_texts():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary())
    encode = token_output.Encoder(vocabulary(), True)
    texts = [t or "" for _, t in ROWS] + ["don't we'll <|endoftext|> x<|startoftext|>y", "é ́a", "  tab\tend\r\n", "a\x00b \x00 c"]
    assert [x.tolist() for x in encode(texts)] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_decontamination(spark):
    other = "an item that stands in no document at all but is long enough to be looked for in every one of them"
    items = spark.createDataFrame([(1, PASSAGE), (2, other), (3, None), (4, "the"), (None, PASSAGE), (5, PASSAGE)], "item_id bigint, text string")
    edited = PASSAGE.replace("quick", "slow").replace("seven", "some seven").replace(" quiet", "")
    rows = [*ROWS, (30, "before " + edited + " after"), (31, " ".join(PASSAGE.split()[::-1]))]
    got = decontamination.find(table(spark, rows), items).collect()
    hit = collections.Counter(r.doc_id for r in got if r.matches)
    assert hit == collections.Counter([None, 5, 6, 7, 7, 7, 30])
    assert {m.item_id for r in got for m in r.matches} == {1, 5}
    assert {r.doc_id: r.matches[0].distance for r in got if r.doc_id == 30} == {30: 3}
    clean = decontamination.clean(table(spark, rows), items)
    assert clean.columns == table(spark).columns and clean.count() == len(rows) - 7
    assert decontamination.clean(table(spark), items.limit(0)).count() == len(ROWS)


def test_short_items_and_scripts_without_spaces(spark):
    han = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    items = spark.createDataFrame([(1, "What is DNA?"), (2, "yes"), (3, han), (4, "U.S. law"), (5, " . "), (6, "ไทย"), (7, "what is dna")], "item_id bigint, text string")
    rows = [(1, "Ask: what is DNA? Nobody knows."), (2, "Tell me what is DNA made of"), (3, "a\nYES\nb"), (4, "yes, of course"), (5, "前言" + han + "後記"), (6, "前言" + han.replace("鳥", "雞") + "後記")]
    rows += [(7, "Notes. U.S. Law. End"), (8, "the U.S. law of it"), (9, "ไทย"), (10, ""), (11, None), (12, han[:9]), (13, "春眠不覺曉"), (3, "a\nYES\nb")]
    got = collections.Counter((r.doc_id, tuple((m.item_id, m.distance, m.start) for m in r.matches)) for r in decontamination.find(table(spark, rows), items).collect())
    want = {1: ((1, 0, 1), (7, 0, 1)), 3: ((2, 0, 1),), 5: ((3, 0, 2),), 6: ((3, 1, 2),), 7: ((4, 0, 1),), 9: ((6, 0, 0),)}
    assert got == collections.Counter((k, want.get(k, ())) for k, _ in rows)


def test_decontamination_equals_brute_force():
    """The search over whole texts against the plain distance of every unit to every text."""
    import random

    r = random.Random(8)
    word = lambda: r.choice("ab cd ef gh ij kl mn op".split())
    for _ in range(60):
        items = {k: [word() for _ in range(r.choice((1, 3, 5, 8, 12, 40)))] for k in range(6)}
        block = decontamination.Matcher()
        for k, ws in items.items():
            block.add(k, " ".join(ws))
        texts = []
        for _ in range(8):
            ws = [word() for _ in range(r.randint(0, 30))]
            if r.random() < 0.7:
                part = list(r.choice(list(items.values())))
                for _ in range(r.randint(0, 3)):
                    part[r.randrange(len(part))] = word()
                ws[len(ws) // 2 : len(ws) // 2] = [*part, "."] if r.random() < 0.5 else part
            texts.append(" ".join(ws))
        for text, found in zip(texts, block.ready().search(texts), strict=True):
            want = {}
            for k, ws in items.items():
                if len(ws) < decontamination.MIN_WORDS:
                    if any(part.split() == ws for part in text.split(".")):
                        want[k] = 0
                    continue
                for unit in decontamination.units(ws):
                    d = edit_distance(unit, text.replace(".", " ").split())
                    if d <= int(len(unit) * decontamination.ERROR_RATE):
                        want[k] = min(want.get(k, d), d)
            assert {m["item_id"]: m["distance"] for m in found} == want


def edit_distance(p, t):
    row = list(range(len(p) + 1))
    best = len(p)
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers():
    import random

    r = random.Random(4)
    for _ in range(300):
        p, t = [r.randrange(4) for _ in range(r.randint(1, 40))], [r.randrange(4) for _ in range(r.randint(0, 60))]
        mask = {}
        for i, c in enumerate(p):
            mask[c] = mask.get(c, 0) | 1 << i
        assert decontamination.distance(mask, len(p), t, len(p))[0] == edit_distance(p, t)


def mixture(spark):
    texts = {"en": "the cat and the dog of this house ", "de": "der hund und die katze über schön "}
    rows = [(k, texts["en" if k % 4 else "de"] * (1 + k % 5)) for k in range(400)] + [(None, None), (1000, ""), (5, texts["de"])]
    docs = table(spark, rows)
    labelled = spark.createDataFrame([(k, "en" if k % 4 else "de") for k in range(0, 400, 3)] + [(7, None), (None, "en"), (8, "xx")], "doc_id bigint, domain string")
    return docs, labelled


def test_mixing(spark):
    import numpy as np

    docs, labelled = mixture(spark)
    found, domains = mixing.rates(docs, labelled, {"en": 0.5, "de": 0.5, "none": 0.0})
    rows = found.collect()
    assert domains == ["de", "en"] and len(rows) == docs.count()
    a = np.array([[x * r.tokens for x in r.posterior] for r in rows])
    share = (a * np.array([[r.rate] for r in rows])).sum(0) / a.sum()
    assert np.allclose(share, 0.5, atol=2e-3)
    # The same least squares by many plain steps.
    t, p, x = a.sum(1) / a.sum(), np.array([r.posterior for r in rows]), np.ones(len(rows))
    natural = (t[:, None] * p).sum(0)
    for _ in range(500):
        x = np.maximum(0, x - p @ (((t * x) @ p - 0.5) / natural) - mixing.RIDGE * (x - 1))
    assert np.allclose(x, [r.rate for r in rows], atol=5e-3)


def test_mixing_keeps_all_with_rates_of_one(spark):
    docs, labelled = mixture(spark)
    out = mixing.mixed(docs, labelled, {"en": 0.5, "de": 0.5}, least=1.0)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mixed(docs, labelled.limit(0), {"en": 1.0}).count() == docs.count()


def test_quality_model_learns(spark):
    good = [(k, " ".join(f"plain words in rows {k * 7 % 13} and {i}" for i in range(3 + k % 20)), 1) for k in range(300)]
    bad = [(1000 + k, " ".join(f"SHOUT!! {i}!!" for i in range(3 + k % 20)), 0) for k in range(300)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    labels = df.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (5, None), (3, 1)], "doc_id bigint, quality int"))
    scored = quality_model.score(df.drop("quality"), labels).withColumn("held", quality_model.held_out(F.col("doc_id"))).join(df.select("doc_id", "quality"), "doc_id").filter("held").collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in scored) / len(scored) > 0.97


def test_quality_model_edges(spark):
    labels = spark.createDataFrame([(5, 1), (14, 0), (16, 1)], "doc_id bigint, quality int")
    got = quality_model.score(table(spark), labels)
    rows = got.collect()
    assert [c for c in got.columns if c != "score"] == [c for c in table(spark).columns if c != "score"]
    assert ids((r.doc_id, r.text) for r in rows) == ids(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.score(table(spark), labels.limit(0)).collect()} == {1.0}


def test_quality_model_learns_from_labels_of_documents_that_are_there(spark, monkeypatch):
    """Most labels are of other documents; long texts are sampled in pieces, repeated rows once."""
    monkeypatch.setattr(quality_model, "SAMPLE", 40)
    rows = [(7 * k, ("long " * 10_000 if k % 3 else "short ") + f"text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string")
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    texts, quality = quality_model.sample(docs, labels)
    assert len(texts) == 80 and quality.sum() == 40 and max(map(len, texts)) == quality_model.SAMPLE_BYTES
    with pytest.warns(UserWarning, match="no document"):
        assert {r.score for r in quality_model.score(docs.limit(3), labels.filter("doc_id > 100000")).collect()} == {1.0}


def test_quality_model_against_plain_loops():
    """Scores by a plain convolution over each document's bytes, and gradients by finite differences."""
    r = np.random.default_rng(4)
    net = quality_model.Network.new()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts = [bytes(r.integers(97, 103, n).astype(np.uint8)) for n in (0, 1, 40, 127, 128, 300)]
    w = net.w
    width, step, half = quality_model.WIDTH, quality_model.STEP, quality_model.HALF

    def plain(t):
        halves = (len(t) + width) // half + 1
        padded = t + bytes(halves * half + width - len(t))
        maxima = []
        for a in range(halves):
            best = np.full(quality_model.FILTERS, -np.inf)
            for p in range(a * half, (a + 1) * half, step):
                y = w["conv_b"].copy()
                for k in range(quality_model.TAPS):
                    y = y + np.concatenate([w["embed"][padded[p + k * step + i]] for i in range(step)]) @ w["conv"][k]
                best = np.maximum(best, y)
            maxima.append(best)
        chunks = np.array([np.maximum(m, maxima[min(i + 1, halves - 1)]) for i, m in enumerate(maxima)])
        hidden = np.maximum(np.concatenate([chunks.max(0), chunks.mean(0), chunks.min(0)]) @ w["dense"] + w["dense_b"], 0)
        return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_b"][0])))

    want = [plain(t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-6)
    labels = np.array([0, 1, 1, 0, 1, 0], float)
    loss = lambda: -np.mean([np.log(p if y else 1 - p) for p, y in zip(net.scores(texts), labels, strict=True)])
    grad = net.gradients(texts, labels)
    for name, values in net.w.items():
        for _ in range(6):
            at = tuple(int(r.integers(97, 103)) if name == "embed" and not i else int(r.integers(0, n)) for i, n in enumerate(values.shape))
            old = values[at]
            values[at] = old + 1e-6
            up = loss()
            values[at] = old - 1e-6
            down = loss()
            values[at] = old
            assert abs((up - down) / 2e-6 - grad[name][at]) < 1e-4


def plain_chain(pieces):
    """The most tokens that any choice of pieces covers, tried in every order of their ends."""
    best = 0

    def go(last, covered):
        nonlocal best
        best = max(best, covered)
        for end, length, at in pieces:
            start, first = end - length, at - length
            cut = 0 if last is None else max(0, last[0] - start, last[1] - first)
            if last is None or end > last[0] and cut < length and start + cut - last[0] <= license_scan.MAX_GAP:
                go((end, at), covered + length - cut)

    go(None, 0)
    return best


def test_chains_cover_most():
    r = np.random.default_rng(6)
    for _ in range(300):
        pieces = sorted((int(r.integers(3, 40)), int(r.integers(3, 9)), int(r.integers(3, 30))) for _ in range(7))
        pieces = [(end, min(n, end, at), at) for end, n, at in pieces]
        assert max(c[0] for c in license_scan.chains(pieces)) == plain_chain(pieces)


def test_edited_notices_are_found_wherever_a_chain_covers_enough():
    """Notices with words left out, put in and doubled: a label is missed only where no chain of its template's places covers enough."""
    r = np.random.default_rng(8)
    scan = license_scan.scanner()
    found = 0
    for _ in range(400):
        label, notice = license_scan.NOTICES[int(r.integers(0, len(license_scan.NOTICES)))]
        w = notice.split()
        for _ in range(int(r.integers(1, 4))):
            i = int(r.integers(0, len(w)))
            w[i : i + 1] = [[], [w[i], "inserted"], w[max(0, i - 3) : i + 1]][int(r.integers(0, 3))]
        tokens = [x.encode() for x in w]
        want = set()
        for name, template in scan.templates:
            ids = [scan.vocabulary.get(x) for x in tokens]
            # Maximal matches by plain comparison: the longest part of any template that ends at a place, not to be longer at the next.
            ends = [max((n for n in range(1, i + 2) if any(ids[i + 1 - n : i + 1] == t[b : b + n] for _, t in scan.templates for b in range(len(t) - n + 1))), default=0) for i in range(len(ids))]
            longest = [(i + 1, n) for i, n in enumerate(ends) if n >= license_scan.MIN_RUN and (i + 1 == len(ends) or ends[i + 1] != n + 1)]
            pieces = [(e, n, b + n) for e, n in longest for b in range(len(template) - n + 1) if template[b : b + n] == ids[e - n : e]]
            if pieces and plain_chain(pieces) >= license_scan.MIN_COVERED * len(template):
                want.add(name)
        got = {x[0] for x in scan.scan(tokens)[1]}
        assert got == want, (w, got, want)
        found += label in got
    assert found > 200


def test_columns_of_any_name_are_carried(spark):
    df = table(spark, ROWS[:6]).withColumns({"a.b": F.lit(1), "back`tick": F.lit(2)})
    labels = spark.createDataFrame([(5, 1), (14, 0)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    for got in (quality_model.score(df, labels), decontamination.find(df, items), decontamination.clean(df, items), near_dedup.representatives(df)):
        rows = got.collect()
        assert set(df.columns) <= set(got.columns) and rows and {r["a.b"] for r in rows} == {1} and {r["back`tick"] for r in rows} == {2}


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    for df in (
        near_dedup.classify(none), near_dedup.representatives(none), suffix_dedup.remove(none), license_scan.find(none), pii.find(none), quality_rules.judge(none), decontamination.find(none, items),
        mixing.rates(none, spark.createDataFrame([], "doc_id bigint, domain string"), {"en": 1.0})[0], quality_model.score(none, labels), token_output.read(spark.createDataFrame([], token_output.BLOCKS_SCHEMA)), token_output.blocks(none, vocabulary()),
    ):
        assert df.count() == 0
