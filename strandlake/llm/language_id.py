"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into stretches of at most WIDTH bytes of nearly equal length. Over each stretch one recurrent layer runs
from the left and one from the right, from a zero state; both states at a byte give the probabilities of the languages at
that byte. Every byte of the whole text is labelled, and a document's probabilities are the mean over its bytes.

The network is trained on the driver by backpropagation through time, each byte with its document's language. The sample
is bounded: the LANGUAGES most frequent languages, SAMPLE documents of each, PER_TEXT stretches spread evenly over each
of these texts. Held-out documents and those without a number, text or language are not trained on; of repeated rows with
one number the least text is.

Null texts and texts without a letter are `und` with score 0, and so is everything where no document has a language to
learn. Among equal probabilities the language that is first in code-point order is given. Very long texts are read in
stretches like others; repeated rows get equal results; an empty table gives an empty one. Columns but doc_id, text and
(for learning) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality_model import held_out

UNITS, WIDTH = 8, 192
LANGUAGES, SAMPLE, PER_TEXT = 256, 400, 4
ROUNDS, BATCH, RATE = 4, 64, 0.02
LANES = 1024
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def cut(sizes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other: text, start and length of each stretch, in order (none of empty texts)."""
    parts = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    n, m = sizes[text], np.maximum(parts[text], 1)
    a, b = n * k // m, n * (k + 1) // m
    return text, (np.cumsum(sizes) - sizes)[text] + a, b - a


def lanes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches side by side: row t has byte t of each (any byte beyond its end)."""
    at = start[None, :] + np.arange(int(size.max(initial=0)))[:, None]
    return flat[np.minimum(at, len(flat) - 1)]


class Network:
    """w: for either direction (0 from the left, 1 from the right) `in` (gates by byte), `on` (gates by state) and `out`;
    `bias`. Gates are update, reset and candidate, UNITS rows each."""

    def __init__(self, classes: int, units: int = UNITS, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.units = units
        self.w = {"in": make(2, 3 * units, 256, scale=0.3), "on": make(2, 3 * units, units, scale=units**-0.5), "out": make(2, classes, units, scale=units**-0.5), "bias": np.zeros(classes, np.float32)}

    def states(self, x: np.ndarray, size: np.ndarray, side: int) -> np.ndarray:
        """The state at each byte: (step, unit, stretch); 0 beyond a stretch's end when it comes from the right."""
        h = self.units
        half = np.repeat(np.float32([0.5, 1]), [2 * h, h])[:, None]  # a sigmoid is a hyperbolic tangent of half the argument
        enter, on = self.w["in"][side] * half, self.w["on"][side] * half
        steps, n = x.shape
        out = np.empty((steps, h, n), np.float32)
        state, a, u = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        shortest = int(size.min(initial=steps))
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.take(enter, x[t], axis=1, out=a, mode="clip")
            np.matmul(on, state, out=u)
            gates, new = a[: 2 * h], u[2 * h :]
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new *= gates[h:]
            new += a[2 * h :]
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=out[t])
            state *= gates[:h]
            state += new
            if side and t >= shortest:
                state *= size > t
        return out

    def pooled(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The sum of the probabilities at all bytes of each stretch: (class, stretch)."""
        left, right = self.states(x, size, 0), self.states(x, size, 1)
        total = np.zeros((len(self.w["bias"]), x.shape[1]), np.float64)
        shortest = int(size.min(initial=len(x)))
        for t in range(len(x)):
            p = self.w["out"][0] @ left[t]
            p += self.w["out"][1] @ right[t]
            p += self.w["bias"][:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total += p if t < shortest else p * (size > t)
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(text, class); 0 for empty texts. Stretches are taken by length, so that those side by side end together."""
        flat = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        text, start, size = cut(sizes)
        sums = np.zeros((len(self.w["bias"]), len(text)))
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), LANES):
            pick = order[k : k + LANES]
            sums[:, pick] = self.pooled(lanes(flat, start[pick], size[pick]), size[pick])
        out = np.stack([np.bincount(text, row, len(texts)) for row in sums], axis=1) if len(sums) else np.zeros((len(texts), 0))
        return out / np.maximum(sizes, 1)[:, None]

    def loss(self, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes, and its gradient: backpropagation through time in either direction."""
        w, (steps, n) = self.w, x.shape
        valid = np.arange(steps)[:, None] < size
        states = np.stack([self.states(x, size, side) for side in (0, 1)])  # (side, step, unit, stretch)
        y = w["out"][0] @ states[0] + w["out"][1] @ states[1] + w["bias"][:, None]
        y -= y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        right = p[:, label, np.arange(n)]
        d_y = p
        d_y[:, label, np.arange(n)] -= 1
        d_y *= (valid / valid.sum())[:, None, :]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["bias"] = d_y.sum(axis=(0, 2))
        g["out"] = np.stack([np.tensordot(d_y, states[side], ([0, 2], [0, 2])) for side in (0, 1)])
        for side in (0, 1):
            g["in"][side], g["on"][side] = self.back(x, valid, states[side], w["out"][side].T @ d_y, side)
        return float(-(np.log(np.maximum(right, 1e-30)) * valid).sum() / valid.sum()), g

    def back(self, x: np.ndarray, valid: np.ndarray, states: np.ndarray, d_states: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights of one direction from those of its states."""
        enter, on, h = self.w["in"][side], self.w["on"][side], self.units
        steps, n = x.shape
        d_enter, d_on = np.empty((steps, 3 * h, n), np.float32), np.zeros_like(on)
        carry, none = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
            before = t - 1 if side == 0 else t + 1
            state = states[before] if 0 <= before < steps else none
            a, u = enter[:, x[t]], on @ state
            z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * u[2 * h :])
            d = d_states[t] + carry
            if side:
                d = d * valid[t]
            d_new = d * (1 - z) * (1 - new * new)
            gates = d_enter[t]
            gates[:h] = d * (state - new) * z * (1 - z)
            gates[h : 2 * h] = d_new * u[2 * h :] * r * (1 - r)
            gates[2 * h :] = d_new
            d_u = np.concatenate([gates[: 2 * h], d_new * r])
            d_on += d_u @ state.T
            carry = d * z + on.T @ d_u
        which = x.ravel()
        return np.stack([np.bincount(which, d_enter[:, k].ravel(), 256) for k in range(3 * h)]).astype(np.float32), d_on

    def fit(self, stretches: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
        """Adam over shuffled batches, with a rate that falls to zero."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        flat, size = np.frombuffer(b"".join(stretches) or b"\0", np.uint8), np.array([len(s) for s in stretches], np.int64)
        start, t = np.cumsum(size) - size, 0
        total = ROUNDS * -(-len(stretches) // BATCH)
        for _ in range(ROUNDS):
            order = r.permutation(len(stretches))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                rate = RATE * (1 - t / total)
                t += 1
                for name, g in self.loss(lanes(flat, start[pick], size[pick]), size[pick], labels[pick])[1].items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.w[name] = (self.w[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """The bounded training sample: language and bytes of each stretch, in a fixed order."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text != '' and lang is not null").filter(~held_out(F.col("doc_id")))
    often = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    # A fraction by hash first, so that no window sees all documents of a language.
    some = known.select("doc_id", "lang").distinct().join(often, "lang").filter(F.pmod(F.xxhash64("doc_id"), "n") < 4 * SAMPLE)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = F.broadcast(some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE).select("doc_id", "lang"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                parts = -(-len(raw) // WIDTH)
                for k in sorted({i * parts // PER_TEXT for i in range(PER_TEXT)}):
                    rows.append((lang, str(d), k, raw[len(raw) * k // parts : len(raw) * (k + 1) // parts]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["lang", "id", "k", "part"])

    texts = known.join(ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = common.small_batches(texts).mapInArrow(spread, "lang string, id string, k bigint, part binary").collect()
    return [(r.lang, bytes(r.part)) for r in sorted(rows, key=lambda r: (r.lang, r.id, r.k))]


def trained(docs: DataFrame) -> tuple[list[str], Network | None]:
    """The learned languages in code-point order and the network; none of either without a labelled document."""
    found = sample(docs)
    languages = sorted({lang for lang, _ in found})
    number = {lang: k for k, lang in enumerate(languages)}
    return languages, Network(len(languages)).fit([part for _, part in found], np.array([number[lang] for lang, _ in found], np.int64)) if found else None


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            texts = [t.as_buffer().to_pybytes() if ok else b"" for t, ok in zip(text, letters, strict=True)]
            if network is None:
                best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                p = network.probabilities(texts)
                best = [languages[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), letters, strict=True)]
                score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score: learns from the rows of docs that have a lang, and labels all of them."""
    return predict(docs, *trained(docs))
