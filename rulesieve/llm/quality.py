"""Text quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP, the last one ending where the text ends, so
that they cover the whole document.  Each byte has a learned vector; learned filters over WIDTH bytes, every STEP bytes, are
max-pooled inside a chunk.  Over the chunks the strongest and the mean response of each filter are combined linearly into
one probability.

Fitting: of each class the SAMPLE labelled rows with the smallest hashes of their ids, in that order as long as their texts
have FIT_BYTES bytes together; the texts of these rows, whole, are all that reaches the driver.  The classes' weights restore
their shares among all labelled rows, which are counted over the whole table.  Adam, a fixed seed.

Scoring goes through every chunk of every text, a bounded number at a time, so a text's length doesn't matter.

Defined results: a null text counts as empty; an empty text is one chunk of zeros; rows without a label, or with one that is
neither 0 nor 1, are not learned from; with one class, or none, all scores are that class's share (0.5 without any); of rows
that repeat a sampled id one text, the least by MD5, is learned from; rows that repeat get a score each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, texts_of

CHUNK, OVERLAP = 512, 64
WIDTH, STEP = 16, 2
DIM, FILTERS = 6, 24
SAMPLE = 1200
FIT_BYTES = 3 << 20
EPOCHS = 25
BATCH = 48
RATE = 0.01
SEED = 20240601
LEAST = 0.7
_AT_ONCE = 96


def chunks_of(data: bytes) -> np.ndarray:
    """The chunks, one a row; a short text is filled up with zeros."""
    if len(data) <= CHUNK:
        own = np.zeros((1, CHUNK), np.uint8)
        own[0, : len(data)] = np.frombuffer(data, np.uint8)
        return own
    row = np.frombuffer(data, np.uint8)
    hop = CHUNK - OVERLAP
    starts = np.append(np.arange(0, len(row) - CHUNK, hop), len(row) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(row, CHUNK)[starts]


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def responses(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The filters' largest responses in each chunk, before the bias, and the places."""
        tops, places = [], []
        for i in range(0, len(chunks), _AT_ONCE):
            own = self.p["bytes"][chunks[i : i + _AT_ONCE]]
            n, s = len(own), own.strides
            wide = np.lib.stride_tricks.as_strided(own, (n, (CHUNK - WIDTH) // STEP + 1, WIDTH * DIM), (s[0], STEP * s[1], s[2]))
            out = (np.ascontiguousarray(wide).reshape(-1, WIDTH * DIM) @ self.p["filters"]).reshape(n, -1, FILTERS)
            tops.append(out.max(axis=1))
            if where:
                places.append(out.argmax(axis=1))
        return np.concatenate(tops), np.concatenate(places) if where else None

    def pooled(self, tops: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text the filters' largest and mean activations over its chunks; texts begin at starts."""
        act = np.maximum(tops + self.p["bias"], 0)
        sizes = np.diff(np.append(starts, len(tops)))[:, None]
        return np.concatenate([np.maximum.reduceat(act, starts), np.add.reduceat(act, starts) / sizes], axis=1)

    def logits(self, tops: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(tops, starts) @ self.p["out"] + self.p["base"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at, tops, starts, rows = np.zeros(len(texts)), 0, [], [], 0
        held: list[np.ndarray] = []

        def flush() -> None:
            nonlocal held
            if held:
                tops.append(self.responses(np.concatenate(held))[0])
                held = []

        for text in texts:
            own = chunks_of((text or "").encode("utf-8", "surrogatepass"))
            starts.append(rows)
            rows += len(own)
            for i in range(0, len(own), 4096):
                held.append(own[i : i + 4096])
                at += len(held[-1])
                if at >= 4096:
                    flush()
                    at = 0
        flush()
        if len(texts):
            out = 1 / (1 + np.exp(-np.clip(self.logits(np.concatenate(tops), np.array(starts)).astype(np.float64), -40, 40)))
        return out

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        chunks = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        tops, places = self.responses(chunks, where=True)
        pooled = self.pooled(tops, starts)
        logit = pooled @ self.p["out"] + self.p["base"][0]
        error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * weights / len(docs)).astype(np.float32)
        act = np.maximum(tops + self.p["bias"], 0)
        of = np.repeat(np.arange(len(docs)), sizes)
        back = error[:, None] * self.p["out"][None, :]
        best = act == pooled[of, :FILTERS]
        share = best / np.maximum(np.add.reduceat(best, starts)[of], 1)
        top = (share * back[of, :FILTERS] + back[of, FILTERS:] / sizes[of][:, None]) * (act > 0)
        at = places[:, :, None] * STEP + np.arange(WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], at]
        wide = self.p["bytes"][seen].reshape(len(chunks), FILTERS, WIDTH * DIM)
        spread = top[:, :, None] * self.p["filters"].T[None, :, :]
        spread = spread.reshape(-1, DIM)
        codes = seen.reshape(-1)
        return {
            "bytes": np.stack([np.bincount(codes, spread[:, k], 256) for k in range(DIM)], 1).astype(np.float32),
            "filters": np.einsum("cf,cfk->kf", top, wide),
            "bias": top.sum(axis=0),
            "out": error @ pooled,
            "base": error.sum(keepdims=True),
        }


def fitted(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = SEED) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps, total = 0, EPOCHS * -(-len(docs) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            grads = net.gradients([docs[k] for k in own], labels[own], weights[own])
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, g in grads.items():
                g = g + 1e-4 * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
    return net


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, fit_bytes: int) -> list:
    """(label, text) of the sampled rows."""
    ids = None
    for label in (0, 1):
        own = labels.where(F.col("quality") == label).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = own if ids is None else ids.union(own)
    ids = F.broadcast(ids.select(F.col("doc_id").alias("__rs_id"), F.col("quality").cast("int").alias("quality")))  # 2 * sample rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("__rs_id"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    order = W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")  # sample rows a class at most
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("bytes") <= fit_bytes)
    return sorted(((r["quality"], r["doc_id"], r["text"]) for r in rows.select("quality", "doc_id", "text").collect()), key=lambda x: (x[1], x[0]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> Network:
    """A network from the labelled rows; labels: doc_id, quality."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    shares = {int(r[0]): r[1] for r in labels.groupBy("quality").count().collect()}  # two rows at most
    rows = _sampled(docs, labels, sample, fit_bytes) if len(shares) == 2 else []
    found = np.array([r[0] for r in rows])
    if len(set(found.tolist())) < 2:
        net = Network()
        share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
        net.p["out"][:] = 0
        net.p["base"][0] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return net
    weight = {k: shares[k] / sum(shares.values()) / np.mean(found == k) for k in (0, 1)}
    chunks = [chunks_of(r[2].encode("utf-8", "surrogatepass")) for r in rows]
    return fitted(chunks, found.astype(np.float32), np.array([weight[int(k)] for k in found], np.float32))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for i in range(0, len(texts), 256):
                yield pa.record_batch([batch.column(0).slice(i, 256), pa.array(net.scores(texts[i : i + 256]), pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return map_batches(rows, work, rows.select("doc_id").schema.add("score", "double"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    net = learn(docs, labels.where(rest != 2))
    return score(docs, net).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
