"""A byte-level convolutional network in numpy that scores documents for quality.

Bytes are embedded; learned filters of WIDTH bytes move over the whole document in steps of STEP. Responses are
max-pooled within overlapping chunks (a chunk is two neighbouring halves of HALF bytes), the chunk maxima are combined
over the document by their maximum, mean and minimum, and a small dense layer gives one probability.

The network is trained on the driver on a bounded sample: at most SAMPLE labelled documents of each class, by the least
hash of doc_id, of texts of more than SAMPLE_BYTES bytes PIECES pieces spread evenly over the whole. Labels of documents
that aren't there don't count. Scoring reads every text whole, in blocks of bounded memory.

Null and empty texts score as a chunk of padding. Rows without a label, with a null label or with a null doc_id are not
trained on; of several labels for a document the least counts, of several texts the least. Where no document has a label
nothing can be rejected: every score is 1, with a warning. Repeated rows get the same score; an empty table gives an empty result; lang, source and other columns are
never read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
HALF = 128
TAPS = WIDTH // STEP
SAMPLE, SAMPLE_BYTES, PIECES = 1200, 16384, 16
ROUNDS, BATCH, RATE = 5, 32, 0.01
BLOCK = 1 << 18
THRESHOLD = 0.7


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in whole halves, each padded by WIDTH bytes at least, so that no filter reaches from one into the next; and where each begins."""
    halves = np.array([(len(t) + WIDTH) // HALF + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(halves)])
    flat = bytearray(int(first[-1]) * HALF + WIDTH)
    for t, k in zip(texts, first[:-1].tolist(), strict=True):
        flat[k * HALF : k * HALF + len(t)] = t
    return np.frombuffer(flat, np.uint8), first


@dataclass
class Network:
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls({"embed": make(256, DIM, scale=0.5), "conv": make(TAPS, STEP * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), "conv_b": np.zeros(FILTERS, np.float32), "dense": make(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5), "dense_b": np.zeros(HIDDEN, np.float32), "out": make(HIDDEN, scale=HIDDEN**-0.5), "out_b": np.zeros(1, np.float32)})

    def responses(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at each place of whole halves, before pooling; flat has WIDTH bytes more than they."""
        x = self.w["embed"][flat].reshape(-1, STEP * DIM)
        n = (len(flat) - WIDTH) // STEP
        y = x[:n] @ self.w["conv"][0]
        for k in range(1, TAPS):
            y += x[k : k + n] @ self.w["conv"][k]
        y += self.w["conv_b"]
        return x, y.reshape(-1, HALF // STEP, FILTERS)

    @staticmethod
    def closed(y: np.ndarray, last: np.ndarray) -> np.ndarray:
        """y, in which the places at the end of a document's last half don't count: their filters reach into the next
        document. What they would see of their own is padding only, as the place before them does."""
        y[last, 1 - TAPS :] = -np.inf
        return y

    def half_maxima(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = (len(flat) - WIDTH) // HALF
        per = BLOCK // HALF
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        return np.concatenate([self.closed(self.responses(flat[a * HALF : min(n, a + per) * HALF + WIDTH])[1], last[a : a + per]).max(axis=1) for a in range(0, n, per)])

    @staticmethod
    def chunk_ends(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, the half that completes its chunk: the next one of its document, or itself at the end."""
        n = int(first[-1])
        other = np.arange(1, n + 1)
        other[first[1:] - 1] = first[1:] - 1
        return np.arange(n), other

    def combined(self, maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.chunk_ends(first)
        chunk = np.maximum(maxima[a], maxima[b])
        start, size = first[:-1], np.diff(first)[:, None]
        return np.concatenate([np.maximum.reduceat(chunk, start), np.add.reduceat(chunk, start) / size, np.minimum.reduceat(chunk, start)], axis=1)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.w["dense"] + self.w["dense_b"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_b"], -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Documents are laid out a bounded number of bytes at a time; one document is never split."""
        out, group, held = [], [], 0
        for t in [*texts, None]:
            if group and (t is None or held + len(t) > 4 * BLOCK):
                flat, first = laid_out(group)
                out.append(self.head(self.combined(self.half_maxima(flat, first), first))[1])
                group, held = [], 0
            if t is not None:
                group.append(t)
                held += len(t)
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        flat, first = laid_out(texts)
        x, y = self.responses(flat)
        y = self.closed(y, first[1:] - 1)
        n = len(y)
        where = y.argmax(axis=1)
        maxima = np.take_along_axis(y, where[:, None], 1)[:, 0]
        a, b = self.chunk_ends(first)
        left = maxima[a] >= maxima[b]
        chunk = np.where(left, maxima[a], maxima[b])
        start, size = first[:-1], np.diff(first)
        doc = np.repeat(np.arange(len(texts)), size)
        most, least = np.maximum.reduceat(chunk, start), np.minimum.reduceat(chunk, start)
        pooled = np.concatenate([most, np.add.reduceat(chunk, start) / size[:, None], least], axis=1)
        hidden, p = self.head(pooled)
        d_logit = ((p - label) / len(texts)).astype(np.float32)
        g = {"out": hidden.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_hidden = np.outer(d_logit, w["out"]) * (hidden > 0)
        g["dense"], g["dense_b"] = pooled.T @ d_hidden, d_hidden.sum(0)
        d_pool = d_hidden @ w["dense"].T
        d_chunk = d_pool[doc, FILTERS : 2 * FILTERS] / size[doc, None]
        for k, best in ((0, most), (2, least)):
            hit = chunk == best[doc]
            ties = np.add.reduceat(hit.astype(np.float32), start)
            d_chunk += hit * (d_pool[:, k * FILTERS : (k + 1) * FILTERS] / ties)[doc]
        d_half = np.zeros_like(maxima)
        np.add.at(d_half, a, d_chunk * left)
        np.add.at(d_half, b, d_chunk * ~left)
        place = (np.arange(n)[:, None] * (HALF // STEP) + where).ravel()  # of the winning window of each half and filter
        grad = d_half.ravel()
        which = np.tile(np.arange(FILTERS), n)
        g["conv_b"] = d_half.sum(0)
        g["conv"] = np.empty_like(w["conv"])
        d_x = np.zeros_like(x)
        for k in range(TAPS):
            rows = x[place + k].reshape(n, FILTERS, -1)
            g["conv"][k] = np.einsum("nfd,nf->df", rows, d_half)
            np.add.at(d_x, place + k, grad[:, None] * w["conv"][k].T[which])
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], flat, d_x.reshape(-1, DIM))
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
        """Adam over shuffled batches; the pass over the sample is repeated ROUNDS times."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        t = 0
        for _ in range(ROUNDS):
            order = r.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                t += 1
                for k, g in self.gradients([texts[i] for i in pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def thinned(text: bytes) -> bytes:
    """text itself, or PIECES pieces spread over it if it is long."""
    if len(text) <= SAMPLE_BYTES:
        return text
    size = SAMPLE_BYTES // PIECES
    return b"".join(text[a : a + size] for a in ((len(text) - size) * k // (PIECES - 1) for k in range(PIECES)))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The bounded training sample, by the hash of doc_id; its ids, at most 2 * SAMPLE, are broadcast."""
    one = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = lambda q: one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = common.documents(docs).join(F.broadcast(few(0).unionByName(few(1))), "doc_id").groupBy("quality", F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [thinned(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), batch.column("doc_id").cast(pa.string()), pa.array(short, pa.binary())], names=["quality", "h", "id", "text"])

    rows = sorted(texts.mapInArrow(run, "quality int, h bigint, id string, text binary").collect(), key=lambda r: (r.quality, r.h, r.id))
    return [bytes(r.text) for r in rows], np.array([r.quality for r in rows], np.float32)


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    texts, quality = sample(docs, labels)
    if not texts:
        warnings.warn("no document that is not held out has a label: nothing is learnt and every document scores 1", stacklevel=2)
    return Network.new().fit(texts, quality) if texts else None


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs, and score, in place of any column of that name."""
    from pyspark.sql import types as T

    network = trained(docs, labels)
    boxed = common.boxed(docs)
    schema = T.StructType([*boxed.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                p = network.scores(texts).astype(np.float64) if network else np.ones(len(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    return common.unboxed(common.small_batches(boxed).mapInArrow(run, schema), docs, "score")
