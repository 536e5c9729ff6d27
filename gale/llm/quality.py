"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with temperature-calibrated probabilities.

Method
  1. *Random indexing* over all documents. A token (letters in lower case, a
     run of punctuation, numbers and all-capital words as one token each) falls
     into one of ``buckets``; a bucket's index vector has four +-1 entries fixed
     by its number. A bucket's context vector is the sum of the index vectors of
     the tokens up to two places away. Every task adds up its own matrix of
     fixed size; the matrices meet in one grouped sum.
  2. *Pooling.* A document is the mean over its tokens of (centred, normalised
     context vector; index vector), the lengths of these two means (long if few
     different words make the text), the share of neighbours in one bucket and
     the number of tokens on a log scale.
  3. *Network.* tanh layer and logistic output, trained with Adam on at most
     ``max_train`` labelled rows (those with the smallest hash of the id), a
     fifth of which only sets the temperature that makes the probabilities
     honest.
  4. Every whole text is scored in its task with the broadcast model
     (``buckets`` x 2 x ``DIM`` numbers).

The score depends on the text alone.

Defined results
  null text is empty; an empty text pools to zero and gets the network's answer
  for it; a document with several labels counts with their mean, a mean of
  one half and null labels are left out; null ids have no label; without labels
  of both kinds the score is their mean (0.5 without any); repeated rows each
  get their row; empty table: empty result; other columns are ignored, in
  :func:`keep_quality` passed through.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.llm.common import Scratch, id_hash, pick

DIM = 64
BUCKETS = 8192
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """token -> bucket; emptied when full."""

    def __init__(self, buckets: int, size: int = 100_000):
        super().__init__()
        self.buckets, self.size = buckets, size

    def __missing__(self, token: str) -> int:
        if len(self) >= self.size:
            self.clear()
        if token[0].isdigit():
            word = "\0number"
        elif len(token) > 1 and token.isupper():
            word = "\0capitals"
        elif token[0].isalpha():
            word = token.lower()
        else:
            word = "\0" + token[:3]
        out = zlib.crc32(word.encode()) % self.buckets
        if len(token) <= 64:
            self[token] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        return np.fromiter((self[t] for t in tokens), np.int64, len(tokens))


def index_vectors(buckets: int, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places (buckets, 4) and signs of the nonzero entries."""
    rng = np.random.default_rng(20240229)
    place = rng.permuted(np.tile(np.arange(dim), (buckets, 1)), axis=1)[:, :4]
    return place, rng.choice([-1.0, 1.0], (buckets, 4))


def _add(total: np.ndarray, docs: list[np.ndarray], buckets: int, place: np.ndarray, sign: np.ndarray) -> None:
    # two empty places between documents: no neighbours across them
    gap = np.array([-1, -1])
    flat = np.concatenate([x for d in docs for x in (d, gap)])
    for far in (1, 2):
        ok = (flat[far:] >= 0) & (flat[:-far] >= 0)
        right, left = flat[far:][ok], flat[:-far][ok]
        for me, other in ((right, left), (left, right)):
            for j in range(4):
                total += np.bincount(me * DIM + place[other, j], sign[other, j], buckets * DIM)


def _accumulate(buckets: int):
    def run(batches):
        place, sign = index_vectors(buckets)
        ids, total, docs, n = Buckets(buckets), np.zeros(buckets * DIM), [], 0
        for b in batches:
            for t in b.column("text"):
                docs.append(ids.of(t.as_py()))
                n += len(docs[-1])
                if n > 200_000:
                    _add(total, docs, buckets, place, sign)
                    docs, n = [], 0
        if docs:
            _add(total, docs, buckets, place, sign)
        m = total.reshape(buckets, DIM)
        used = np.nonzero(np.abs(m).sum(1))[0]
        yield pa.record_batch({"bucket": pa.array(used)} | {f"v{i}": pa.array(m[used, i]) for i in range(DIM)})
    return run


def word_vectors(docs: DataFrame, scratch: Scratch, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """(buckets, 2 DIM): normalised context vectors beside the index vectors."""
    cols = [f"v{i}" for i in range(DIM)]
    parts = pick(docs, text=text_col).mapInArrow(
        _accumulate(buckets), "bucket long, " + ", ".join(f"{c} double" for c in cols))
    summed = scratch.write(parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]), "vectors")
    got = summed.toPandas()  # at most ``buckets`` rows
    context = np.zeros((buckets, DIM))
    context[got["bucket"].to_numpy(np.int64)] = got[cols].to_numpy(float)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    seen = norm[:, 0] > 0
    if seen.any():
        context[seen] -= context[seen].mean(0)
    place, sign = index_vectors(buckets)
    index = np.zeros((buckets, DIM))
    np.put_along_axis(index, place, sign, axis=1)
    return np.concatenate([context, index], axis=1).astype(np.float32)


EXTRA = 4


def pool(text: str | None, ids: Buckets, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(vectors.shape[1] + EXTRA, np.float32)
    own, mean = ids.of(text), out[:-EXTRA]
    for lo in range(0, len(own), 65536):
        mean += vectors[own[lo:lo + 65536]].sum(0)
    if len(own):
        mean /= len(own)
        same = np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0.0
        out[-EXTRA:] = np.linalg.norm(mean[:DIM]), np.linalg.norm(mean[DIM:]), same, math.log1p(len(own)) / 10
    return out


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 32, epochs: int = 60) -> dict:
    """Adam on the rows not in ``held``; the temperature on those in ``held``."""
    if len(np.unique(y)) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    rng = np.random.default_rng(7)
    mean, std = x[~held].mean(0), x[~held].std(0) + 1e-3
    z = (x - mean) / std
    p = {"w1": rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden),
         "w2": rng.normal(0, 1 / math.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    rows = np.nonzero(~held)[0]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            a, t = z[part], t + 1
            h = np.tanh(a @ p["w1"] + p["b1"])
            e = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[part]) / len(part)
            back = e[:, None] * p["w2"] * (1 - h * h)
            grad = {"w1": a.T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * p["w2"], "b2": e.sum()}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    model = p | {"mean": mean, "std": std, "temperature": 1.0}
    if held.any():
        logit, truth = logits(model, x[held]), y[held]
        grid = np.exp(np.linspace(math.log(0.25), math.log(8), 71))
        loss = [np.mean(np.logaddexp(0, -(2 * truth - 1) * logit / g)) for g in grid]
        model["temperature"] = float(grid[int(np.argmin(loss))])
    return model


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.tanh((x - model["mean"]) / model["std"] @ model["w1"] + model["b1"])
    return (h @ model["w2"] + model["b2"]) / model["temperature"]


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(logits(model, x), -500, 500)))


def _pooled(vectors):
    def run(batches):
        ids = Buckets(len(vectors.value))
        for b in batches:
            x = [pool(t.as_py(), ids, vectors.value) for t in b.column("text")]
            yield pa.record_batch({"label": b.column("label"), "held": b.column("held"),
                                   "x": pa.array([v.tobytes() for v in x], pa.binary())})
    return run


def scorer(vectors, model):
    """Scalar UDF: text -> score (both arguments are broadcast variables)."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        ids = Buckets(len(vectors.value))
        width = vectors.value.shape[1] + EXTRA
        x = np.array([pool(t.as_py(), ids, vectors.value) for t in texts], np.float32).reshape(-1, width)
        return pa.array(probabilities(model.value, x), pa.float64())
    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_train: int = 20_000, buckets: int = BUCKETS):
    """(broadcast vectors, broadcast model) learnt from labelled rows whose id hash mod 3 is not 1."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    table = word_vectors(docs, scratch, text_col, buckets)
    vectors = spark.sparkContext.broadcast(table)
    known = pick(labels, doc_id=id_col, label=label_col).filter("doc_id IS NOT NULL AND label IS NOT NULL") \
        .filter(id_hash(F.col("doc_id")) % 3 != 1) \
        .groupBy("doc_id").agg(F.avg("label").alias("mean")).filter("mean <> 0.5") \
        .select(F.col("doc_id").alias("l_id"), (F.col("mean") > 0.5).cast("int").alias("label"))
    d = pick(docs, doc_id=id_col, text=text_col)
    present = d.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("l_id"), "left_semi") \
        .select(F.col("doc_id").alias("l_id")).join(known, "l_id")
    chosen = scratch.write(present.orderBy(F.xxhash64("l_id"), "l_id").limit(max_train), "chosen")
    rows = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")) \
        .select("text", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))
    got = rows.mapInArrow(_pooled(vectors), "label int, held boolean, x binary").toPandas()
    width = table.shape[1] + EXTRA
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width).astype(float)
    model = train(x, got["label"].to_numpy(float), got["held"].to_numpy(bool))
    return vectors, spark.sparkContext.broadcast(model)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", max_train: int = 20_000, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    vectors, model = fit(docs, labels, id_col, text_col, label_col, max_train, buckets)
    d = pick(docs, doc_id=id_col, text=text_col)
    out = d.select("doc_id", (id_hash(F.col("doc_id")) % 3 == 1).alias("held_out"),
                   scorer(vectors, model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality", max_train: int = 20_000,
                 buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with all its columns, without the documents scored below ``threshold``."""
    vectors, model = fit(docs, labels, id_col, text_col, label_col, max_train, buckets)
    return docs.filter(scorer(vectors, model)(F.col(f"`{text_col}`")) >= threshold)
