"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives every token a fixed sparse vector of +1 and -1, drawn from
its hash, and lets a word's vector be the sum of those of its neighbours over the
whole corpus. Tokens are hashed to BUCKETS rows, so the vectors have one size
whatever the vocabulary. A document is the mean and the spread of its tokens'
vectors, its length and its share of distinct tokens; the network that scores
this is trained with numpy on a bounded sample of labelled rows, and a
temperature fitted on labelled rows kept out of it calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.bpe import slices
from geolith.llm.common import TEXTS, let_go, small_batches, written

BUCKETS, WIDTH, NONZERO, WINDOW = 8192, 32, 4, 2
#: Tokens whose pairs are counted together; a longer text is counted alone.
BLOCK = 1 << 18
#: Bytes of text that are scored together.
TOGETHER = 1 << 20
#: Labelled rows that the network learns from, at most; the choice goes by a hash of doc_id.
LABELLED = 20_000
THRESHOLD = 0.3

#: Runs of letters, of digits and of other signs.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Tokens:
    """Bucket numbers of a text's tokens, by hash; those of up to ``most`` tokens of usual length are remembered."""

    def __init__(self, most: int = 200_000, length: int = 40) -> None:
        self.most, self.length, self.known = most, length, {}
        self.numbers = list(range(BUCKETS))

    def forget(self) -> None:
        self.known.clear()

    def ids(self, text: str | None) -> np.ndarray:
        found, known = TOKEN.findall(text or ""), self.known
        try:
            return np.array([known[t] for t in found], np.int64)
        except KeyError:
            import xxhash

            if len(known) > self.most:
                known.clear()
            long = {}
            for t in found:
                if t not in known and t not in long:
                    (known if len(t) <= self.length else long)[t] = self.numbers[xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS]
            return np.array([known[t] if t in known else long[t] for t in found], np.int64)


_tokens = Tokens()


def index_vectors() -> np.ndarray:
    """The fixed sparse vectors: for each bucket NONZERO places of +1 or -1."""
    g = np.random.default_rng(11)
    out = np.zeros((BUCKETS, WIDTH), np.int32)
    places = np.argsort(g.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, g.choice(np.array([-1, 1], np.int32), (BUCKETS, NONZERO)), axis=1)
    return out


def add_contexts(total: np.ndarray, each: list[np.ndarray], index: np.ndarray) -> None:
    """Add to ``total`` (flat) what the neighbours in ``each`` document's ids bring; equal pairs are counted first."""
    codes = [x[:-d] * BUCKETS + x[d:] for x in each for d in range(1, WINDOW + 1) if len(x) > d]
    if not codes:
        return
    codes = np.sort(np.concatenate(codes).astype(np.uint32))  # BUCKETS squared is 2**26
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(first, append=len(codes))
    left, right = np.divmod(codes[first].astype(np.int64), BUCKETS)
    places = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(index, places, axis=1)
    for at, by in ((left, right), (right, left)):
        for k in range(NONZERO):
            total += np.bincount(at * WIDTH + places[by, k], count * signs[by, k], len(total))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, summed over all of ``docs`` (``text``); zero where a bucket never occurs."""
    names = [f"c{i}" for i in range(WIDTH)]

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total = index_vectors(), np.zeros(BUCKETS * WIDTH)
        held, n = [], 0
        for frame in frames:
            for text in frame["text"]:
                held.append(_tokens.ids(text))
                n += len(held[-1])
                if n >= BLOCK:
                    add_contexts(total, held, index)
                    held, n = [], 0
        add_contexts(total, held, index)
        let_go(_tokens)
        total = total.reshape(BUCKETS, WIDTH).astype(np.int64)
        some = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[some], columns=names).assign(bucket=some)

    parts = docs.select("text").mapInPandas(gather, ", ".join(f"{n} long" for n in names) + ", bucket int")
    with small_batches(docs.sparkSession, TEXTS):
        rows = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, WIDTH))
    if rows.num_rows:
        out[rows["bucket"].to_numpy()] = np.stack([rows[n].to_numpy() for n in names], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """The pooled features of each text; a text without tokens has zeros."""
    rows = np.zeros((len(texts), 2 * WIDTH + 3))
    vectors = vectors.astype(float)
    squares = vectors * vectors
    for k, text in enumerate(texts):
        ids = _tokens.ids(text)
        if len(ids):
            some, count = np.unique(ids, return_counts=True)
            share = count / len(ids)
            mean = share @ vectors[some]
            spread = np.sqrt(np.maximum(share @ squares[some] - mean * mean, 0))
            rows[k] = [*mean, *spread, np.log1p(len(ids)), len(some) / len(ids), len(text) / len(ids) / 10]
    return rows


@dataclass
class Network:
    """One hidden layer, with the scaling of its inputs and the temperature of its output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, kept_out: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on the logistic loss over the rows not ``kept_out``; on those the temperature is fitted.

    With no rows, or rows of one class, the score is the share of label 1 (one half without rows), smoothed by one row of each class.
    """
    d = x.shape[1]
    g = np.random.default_rng(seed)
    fit = ~kept_out if 0 < y[~kept_out].sum() < (~kept_out).sum() else np.ones(len(y), bool)
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not 0 < y[fit].sum() < fit.sum():
        return net
    net.mean, net.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    net.w1, net.w2 = g.normal(0, d**-0.5, (d, hidden)), g.normal(0, hidden**-0.5, hidden)
    xs, ys = (x[fit] - net.mean) / net.scale, y[fit]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = g.permutation(len(xs))
        for lo in range(0, len(xs), 128):
            some = order[lo : lo + 128]
            h = np.tanh(xs[some] @ params[0] + params[1])
            delta = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - ys[some]) / len(some)
            back = delta[:, None] * params[2] * (1 - h * h)
            grads = [xs[some].T @ back + 1e-4 * params[0], back.sum(0), h.T @ delta, np.array([delta.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if kept_out.any():
        z, t = net.logits(x[kept_out]), y[kept_out]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(t == 1, -z, z) / k).mean() for k in grid])])
    return net


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass
class Quality:
    """What scores a text: the word vectors and the network."""

    vectors: np.ndarray
    network: Network

    def score(self, texts: pa.Array) -> np.ndarray:
        """The scores of texts, of which a bounded part at a time is taken out of Arrow."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        parts = [features(texts.slice(lo, hi - lo).to_pylist(), self.vectors) for lo, hi in slices(sizes, TOGETHER)]
        return self.network.score(np.concatenate(parts)) if parts else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> Quality:
    """A classifier with word vectors from all of ``docs`` and a network from at most ``most`` labelled rows.

    Held-out rows are never learnt from; those with remainder 1 fit the temperature.
    """
    vectors = word_vectors(docs)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_d")).agg(F.max(label).alias("_y"))
    known = known.where(~held_out("_d")).orderBy(F.xxhash64("_d"), "_d").limit(most)
    known = F.broadcast(written(known, "labelled"))  # at most `most` rows of two numbers
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_d")).select("_d", "_y", "text")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"d": frame["_d"], "y": frame["_y"], "x": list(features(frame["text"].tolist(), vectors))})
        let_go(_tokens)

    with small_batches(docs.sparkSession, TEXTS):
        got = rows.mapInPandas(each, "d long, y int, x array<double>").orderBy(F.xxhash64("d"), "d").limit(most).toArrow()
    if not got.num_rows:
        return Quality(vectors, train(np.zeros((0, 2 * WIDTH + 3)), np.zeros(0), np.zeros(0, bool)))
    x = np.array(got["x"].combine_chunks().flatten(), float).reshape(got.num_rows, -1)
    from zlib import crc32

    tune = np.array([crc32(str(d).encode()) % 5 == 1 for d in got["d"].to_pylist()])
    return Quality(vectors, train(x, got["y"].to_numpy().astype(float), tune))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Texts alone decide a score. Null and empty texts have features of zero and a
    score like others; rows that repeat a doc_id have a score each; a null doc_id
    counts as not held out and has no label. Labels other than 0 and 1 are not
    used; of several for a doc_id the greatest is. Without labels every score is
    one half. Other columns are not read.
    """
    model = fit_quality(docs, labels, most=most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])
        let_go(_tokens)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, TEXTS):
        scored = written(texts.mapInArrow(each, "doc_id long, score double"), "scores")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are, whatever their names.

    Nulls, empty texts, repeated rows and missing labels count as in ``quality_scores``.
    """
    model = fit_quality(docs, labels, most=most)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at).cast(pa.string())) >= threshold))
        let_go(_tokens)

    return docs.mapInArrow(each, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
