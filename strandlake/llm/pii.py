"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns give e-mail addresses, IPv4 addresses, payment cards and telephone numbers. The random field then
scores whole candidate segments (one to MAX_TOKENS consecutive tokens) by features of the complete span, and a dynamic
programme over segmentations chooses boundaries and types jointly. Only tokens AROUND a trigger (digits, an `@`, or a
mixed token) or nearer are segmented, in windows of any length that are merged where they meet: elsewhere there is plain
text only. Of segmentations that score the same the one whose last segment starts first wins, and plain text before the
kinds. The field's spans are added where they touch no base span. It is trained here on sentences made by a fixed rule.

Null and empty texts give no spans; texts of any length are processed whole; repeated rows give repeated results; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
MAX_TOKENS = 6
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Each `@` owns the run of local characters before it, as far as the match before it ended."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Matches of the four base patterns, by start and then kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(small, m.groups()))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# --- the random field -------------------------------------------------------------------------------------------

TOKEN = re.compile(r"\S+")
#: A token that holds one of these is a trigger: digits in numbers, an at sign, digits among letters.
TRIGGER = re.compile(r"[0-9]{3}|@|[0-9]\.[0-9]|[0-9][A-Za-z]{1,8}[0-9]")
AROUND = 3
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=_"
CUES = {"card": {"card", "visa", "credit"}, "phone": {"phone", "tel", "call", "fax"}, "secret": {"token", "key", "secret", "password", "api_key", "apikey"}, "email": {"mail", "email", "e-mail"}, "ip": {"ip", "host", "address"}}


def features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of the whole segment tokens[i:j] and of the words before it."""
    body = " ".join(tokens[i:j]).strip(EDGE)
    n = j - i
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    out = ["bias", f"tokens{n}", f"digits{min(digits, 20)}" if n > 1 or not letters else "mixed" if digits else "word"]
    if "@" in body:
        out.append("at-one" if n == 1 and body.count("@") == 1 and 0 < body.find("@") < len(body) - 1 else "at-odd")
        if "." in body.rpartition("@")[2]:
            out.append("at-dot")
    if n == 1 and body.count(".") == 3 and not letters:
        out.append("quad" if all(p.isdigit() and small(p) for p in body.split(".")) else "quad-odd")
    plain = re.sub(r"[ -]", "", body)
    if plain.isascii() and plain.isdigit():
        out.append("luhn" if 12 <= digits <= 19 and luhn(plain) else "number-long" if digits >= 12 else "number")
    if tokens[i].lstrip(EDGE).startswith("+"):
        out.append("plus-phone" if 9 <= digits <= 15 and not letters and re.fullmatch(r"\+[0-9 ().-]+", tokens[i].lstrip(EDGE)[:1] + body.lstrip("+")) else "plus")
    if n == 1 and len(body) >= 16 and digits >= 3 and letters >= 3 and body.isascii() and body.isalnum():
        out.append("opaque-hex" if re.fullmatch(r"[0-9a-f]+", body) else "opaque")
    before = {t.strip(EDGE).lower() for t in tokens[max(0, i - 3) : i]}
    out += [f"cue-{k}" for k, words in CUES.items() if before & words]
    return out


def made_sentences(seed: int, n: int) -> list[tuple[list[str], list[tuple[int, int, str]]]]:
    """Labelled sentences made by rule: filler words with one or two entities and with distractors."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    low, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def card() -> str:
        head = pick("456", 1) + pick(dig, 14)
        return head + next(c for c in dig if luhn(head + c))

    def secret() -> str:
        alphabet = rng.choice([hexa, hexa, hexa.upper(), low + low.upper() + dig])
        return next(x for x in iter(lambda: pick(alphabet, rng.choice([20, 32, 40, 64])), "") if sum(c in dig for c in x) >= 3 and sum(c not in dig for c in x) >= 3)

    made = {
        "email": lambda: [pick(low, rng.randint(3, 9)) + rng.choice(["", ".", "."]) + pick(dig, 2) + "@" + pick(low, 5) + "." + rng.choice(["com", "org", "example.net"])],
        "ip": lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4))],
        "card": lambda: rng.choice([lambda c: [c], lambda c: [c[:4], c[4:8], c[8:12], c[12:]]])(card()),
        "phone": lambda: rng.choice([["+" + pick("123456789", 1), f"({pick(dig, 3)})", f"{pick(dig, 3)}-{pick(dig, 4)}"], ["+" + pick("123456789", 2) + pick(dig, 9)], ["+" + pick("123456789", 2), pick(dig, 3), pick(dig, 3), pick(dig, 4)]]),
        "secret": lambda: [rng.choice(['"{}"', "{}"]).format(secret())],
    }
    odd = [lambda: [pick(dig, rng.randint(1, 5))], lambda: [str(rng.randint(1900, 2030))], lambda: [f"{pick(dig, 1)}.{pick(dig, 2)}"], lambda: [pick(dig, 16)], lambda: [f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}"], lambda: [pick(low, 9) + pick(dig, 2)], lambda: ["@" + pick(low, 5)], lambda: [pick(dig, 3), pick(dig, 3)]]
    out = []
    for _ in range(n):
        tokens, spans = [], []
        for _ in range(rng.randint(1, 3)):
            tokens += [pick(low, rng.randint(2, 10)) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.6:
                kind = rng.choice(list(made))
                if kind == "secret":
                    tokens += [rng.choice(["token", "key", "secret"]), "="]
                elif rng.random() < 0.3:
                    tokens.append(rng.choice(sorted(CUES[kind])))
                entity = made[kind]()
                spans.append((len(tokens), len(tokens) + len(entity), kind))
                tokens += entity[:-1] + [entity[-1] + rng.choice(["", "", ".", ","])]
            else:
                tokens += rng.choice(odd)()
        out.append((tokens + [pick(low, 4)], spans))
    return [x for x in out if x[0]]


class SemiCRF:
    """A log-linear model of segmentations: a text segment is one token, an entity one to MAX_TOKENS tokens."""

    def __init__(self) -> None:
        self.index: dict[tuple[str, str], int] = {}
        self.w = np.zeros(0)

    def kinds(self, tokens: list[str], i: int, j: int) -> list[tuple[str, list[int]]]:
        """The kinds that the segment may have, with the numbers of its features; a feature that training never saw with a
        kind of entity rules that kind out."""
        got = features(tokens, i, j)
        out = []
        for kind in KINDS if j > i + 1 else ("text", *KINDS):
            ids = [k for f in got if (k := self.index.get((kind, f))) is not None]
            if kind == "text" or len(ids) == len(got):
                out.append((kind, ids))
        return out

    def arcs(self, tokens: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """All segments of a training sentence; their features get numbers."""
        number = lambda kind, f: self.index.setdefault((kind, f), len(self.index))
        spans = [(i, j) for i in range(len(tokens)) for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1)]
        return [(i, j, kind, np.array([number(kind, f) for f in features(tokens, i, j)])) for i, j in spans for kind in (KINDS if j > i + 1 else ("text", *KINDS))]

    def fit(self, data: list, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> SemiCRF:
        """Exact gradients of the log-likelihood by the forward-backward recursion over segments."""
        lattices = [(len(t), self.arcs(t), s) for t, s in data]
        self.w = np.zeros(len(self.index))
        square = np.full(len(self.w), 1e-3)
        flat = []
        for n, arcs, spans in lattices:
            inside = {p for i, j, _ in spans for p in range(i, j)}
            gold = {(i, j, k) for i, j, k in spans} | {(p, p + 1, "text") for p in range(n) if p not in inside}
            flat.append((n, arcs, np.concatenate([a[3] for a in arcs]), np.cumsum([0] + [len(a[3]) for a in arcs])[:-1], np.array([(i, j, k) in gold for i, j, k, _ in arcs], float), np.array([len(a[3]) for a in arcs])))
        for _ in range(rounds):
            grad = -l2 * self.w * len(flat)
            for n, arcs, ids, starts, gold, sizes in flat:
                score = np.add.reduceat(self.w[ids], starts)
                fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
                fwd[0] = bwd[n] = 0.0
                s = score.tolist()
                into: list[list[float]] = [[] for _ in range(n + 1)]
                done = 0
                for a, (i, j, _, _) in enumerate(arcs):  # arcs stand in order of their start
                    while done < i:
                        done += 1
                        fwd[done] = logsum(into[done])
                    into[j].append(fwd[i] + s[a])
                for p in range(done + 1, n + 1):
                    fwd[p] = logsum(into[p])
                out: list[list[float]] = [[] for _ in range(n + 1)]
                last = n
                for a in range(len(arcs) - 1, -1, -1):
                    i, j = arcs[a][:2]
                    while last > i:
                        if last < n:
                            bwd[last] = logsum(out[last])
                        last -= 1
                    out[i].append(s[a] + bwd[j])
                p = np.exp(np.array([fwd[a[0]] + x + bwd[a[1]] for a, x in zip(arcs, s, strict=True)]) - fwd[n])
                np.add.at(grad, ids, np.repeat(gold - p, sizes))
            square += grad * grad
            self.w += rate * grad / np.sqrt(square)
        return self

    def decode(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities, in time and memory linear in the tokens."""
        n, w = len(tokens), self.w.tolist()
        best, back = [0.0] + [-math.inf] * n, [(0, "text")] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
                for kind, ids in self.kinds(tokens, i, j):
                    if (x := best[i] + sum(map(w.__getitem__, ids))) > best[j]:
                        best[j], back[j] = x, (i, kind)
        out, p = [], n
        while p:
            i, kind = back[p]
            if kind != "text":
                out.append((i, p, kind))
            p = i
        return out[::-1]


def logsum(xs: list[float]) -> float:
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


@functools.cache
def trained(seed: int = 7, sentences: int = 160) -> SemiCRF:
    return SemiCRF().fit(made_sentences(seed, sentences))


def windows(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Tokens AROUND triggers or nearer, as ranges."""
    first = end = -1
    for k in (k for k, t in enumerate(tokens) if TRIGGER.search(t)):
        if first >= 0 and k - AROUND > end:
            yield first, end
            first = -1
        if first < 0:
            first = max(0, k - AROUND)
        end = min(len(tokens), k + AROUND + 1)
    if first >= 0:
        yield first, end


def field_spans(text: str, field: SemiCRF) -> list[Span]:
    """Spans that the field finds, without the signs at their edges."""
    if not TRIGGER.search(text):
        return []
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    out: list[Span] = []
    for first, end in windows(tokens):
        for i, j, kind in field.decode(tokens[first:end]):
            a, b = places[first + i][0], places[first + j - 1][1]
            while a < b and text[a] in EDGE:
                a += 1
            while b > a and text[b - 1] in EDGE:
                b -= 1
            if a < b:
                out.append((a, b, kind))
    return out


def spans(text: str, field: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    added = []
    for a, b, kind in field_spans(text, field):
        before = bisect_left(starts, b)  # base spans that start before this one ends
        if not before or reach[before - 1] <= a:
            added.append((a, b, kind))
    return base, sorted(base + added, key=lambda s: (s[0], ORDER[s[2]]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind) in code points, end exclusive."""
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        for batch in batches:
            found = [spans(t, field) for t in batch.column("text").to_pylist()]
            as_rows = lambda k: [[{"start": a, "end": b, "kind": c} for a, b, c in f[k]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_rows(0), kind), pa.array(as_rows(1), kind)], ["doc_id", "base", "spans"])

    return common.documents(docs).mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `find`."""
    from pyspark.sql import functions as F

    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def redact(text: str, found: list[Span]) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans are replaced once."""
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[end:]


def sha(base: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
