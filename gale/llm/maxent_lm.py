"""Hashed maximum-entropy language model with a class-factored softmax.

Method
  P(word | context) = P(class | context) * P(word | class).

  1. *Counts* of all training tokens (grouped in Spark, combined on the map
     side). They give the baseline, the classes and the second factor: the
     classes are the ``classes`` - 1 most frequent word endings (two bytes) and
     one for the rest; inside a class a word has its smoothed share, unseen
     words together one share of ``alpha``.
  2. *Class factor*: a softmax over the classes whose logits sum the weight rows
     of hashed features of the context: previous word, previous two words
     (n-grams), the word two and the word three places back (skips).
  3. *Training*: in each of ``rounds`` rounds every task goes over its share of
     the training documents (together: all of them) with AdaGrad steps from the
     common weights and returns its weight changes, which are averaged, each
     feature row in proportion to how often the tasks saw it.
  4. *Scoring*: every whole text in its task, in numpy blocks. Words among the
     ``frequent`` most frequent have their count in a broadcast table of bounded
     size; the rest of the words (per document, with multiplicity) are joined
     with the counts in Spark. No task needs the whole vocabulary.

Defined results
  null text is empty: the end token alone; the hash of a null id is that of the
  empty text (it is held out); repeated rows each get their row; empty table:
  empty result; without training rows every count is 0 and a token's
  probability is 1 in the baseline, 1 / ``classes`` in the model; other columns
  are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.llm.common import Scratch, id_hash, pick

END = b""  # no word is empty
BLOCK = 8192  # tokens of one numpy step
ROWS = 1 << 14  # weight rows of hashed features
SHORT = 8  # rows of a run of one feature that are added one place at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a UTF-8 text between ASCII white space, then the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def _count(batches):
    total: Counter = Counter()
    for b in batches:
        for t in b.column("text").cast(pa.binary()):
            total.update(words(t.as_py()))
            if len(total) > 300_000:
                yield _counted(total)
                total = Counter()
    yield _counted(total)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(total), pa.binary()), "c": pa.array(list(total.values()), pa.int64())})


class Lexicon:
    """Codes of words: ending class, context hash, log10(count + alpha) of frequent ones.
    Emptied between blocks when it has more than ``size`` words."""

    def __init__(self, endings: dict[bytes, int], frequent: dict[bytes, int], alpha: float, size: int = 800_000):
        self.endings, self.frequent, self.alpha, self.size = endings, frequent, alpha, size
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.rows = np.zeros((1024, 3))
        self.hash = np.zeros(1024, np.uint64)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Codes for the words of the texts that have none, all at once."""
        new = list(set().union(*texts).difference(self.code))
        n, k = len(self.words), len(new)
        if n + k > len(self.rows):
            more = max(n + k, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, 3))])
            self.hash = np.concatenate([self.hash, np.zeros(more, np.uint64)])
        at = slice(n, n + k)
        get, count = self.endings.get, self.frequent.get
        self.rows[at, 0] = np.fromiter((get(w[-2:], 0) for w in new), np.int64, k)
        if self.frequent:
            c = np.fromiter((count(w, 0) for w in new), np.int64, k)
            self.rows[at, 1] = c > 0
            self.rows[at, 2] = np.where(c > 0, np.log10(c + self.alpha), 0.0)
        self.hash[at] = np.fromiter(map(zlib.crc32, new), np.uint64, k) + np.uint64(1)
        self.code.update(zip(new, range(n, n + k)))
        self.words += new

    def encode(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))


def features(h: np.ndarray) -> np.ndarray:
    """(4, n) weight rows of the contexts; ``h``: three empty places (0), then the words' hashes."""
    a, b, c = h[2:-1], h[1:-2], h[:-3]
    with np.errstate(over="ignore"):
        mixed = [a * _MIX, (a * np.uint64(31) + b * np.uint64(0x85EBCA6B) + np.uint64(7)) * _MIX,
                 (b + np.uint64(1 << 40)) * _MIX, (c + np.uint64(1 << 41)) * _MIX]
    return np.stack([(m >> np.uint64(50)).astype(np.int64) for m in mixed])  # 64 - 50 = 14 bits: ROWS


def _blocks(batches, lexicon: Lexicon, most: int = 1 << 17):
    """Groups of documents with their token codes, at most about ``most`` tokens each."""
    docs, n = [], 0

    def coded():
        if len(lexicon.words) > lexicon.size:
            lexicon.reset()
        lexicon.learn([tokens for _, _, tokens in docs])
        return [(b, i, lexicon.encode(tokens)) for b, i, tokens in docs]
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i in range(b.num_rows):
            docs.append((b, i, words(texts[i].as_py())))
            n += len(docs[-1][2])
            if n > most:
                yield coded()
                docs, n = [], 0
    if docs:
        yield coded()


def _contexts(docs, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(4, n) features and the classes of all tokens of the documents."""
    f = np.concatenate([features(np.concatenate([np.zeros(3, np.uint64), lexicon.hash[codes]])) for _, _, codes in docs], axis=1)
    cls = np.concatenate([lexicon.rows[codes, 0] for _, _, codes in docs]).astype(np.int64)
    return f, cls


def shifted_logits(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Logits of all classes, less their maximum."""
    z = weights.take(f[0], 0)
    for row in f[1:]:
        z += weights.take(row, 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = shifted_logits(weights, bias, f)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def log_probability(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Natural log of the class factor of the given classes."""
    z = shifted_logits(weights, bias, f)
    own = z[np.arange(len(cls)), cls]
    np.exp(z, out=z)
    return own - np.log(z.sum(1))


def run_sums(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at ``first`` and have ``n`` rows each.
    Most runs are short: those are added place by place, all runs at once, in reduceat's order."""
    out = rows.take(first, 0)
    long = n > SHORT
    if long.any():
        starts, sizes = first[long], n[long]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        out[long] = np.add.reduceat(rows.take(at, 0), ends - sizes, axis=0)
    left = np.nonzero((n > 1) & ~long)[0]
    left = left[np.argsort(-n[left], kind="stable")]  # the longest first: each place is a leading part
    if len(left):
        starts, sizes = first[left], n[left]
        rest = rows.take(starts + 1, 0)
        for k in range(2, int(sizes[0])):
            more = np.searchsorted(-sizes, -k, "left")  # runs of more than k rows
            rest[:more] += rows.take(starts[:more] + k, 0)
        out[left] += rest
    return out


def _train(model, rate: float):
    def run(batches):
        m = model.value
        start, bias, lexicon = m["weights"], m["bias"], Lexicon(m["endings"], {}, m["alpha"])
        w, sq, seen = start.copy(), np.full(len(start), 1e-2, np.float32), np.zeros(len(start))
        for docs in _blocks(batches, lexicon):
            f_all, cls_all = _contexts(docs, lexicon)
            for lo in range(0, f_all.shape[1], BLOCK):
                f, cls = f_all[:, lo:lo + BLOCK], cls_all[lo:lo + BLOCK]
                g = softmax(w, bias, f)
                g[np.arange(len(cls)), cls] -= 1
                flat = f.reshape(-1).astype(np.uint16)
                order = np.argsort(flat, kind="stable")
                n = np.bincount(flat, minlength=len(w))  # the sorted rows follow each other in these runs
                rows = np.nonzero(n)[0]
                n = n[rows]
                first = np.cumsum(n) - n
                grad = run_sums(g.take(order % len(cls), 0), first, n)
                sq[rows] += np.einsum("ij,ij->i", grad, grad)
                w[rows] -= rate * grad / np.sqrt(sq[rows])[:, None]
                seen[rows] += n
        rows = np.nonzero(seen)[0]
        change = (w[rows] - start[rows]).astype(float) * seen[rows, None]
        yield pa.record_batch({"row": pa.array(rows), "seen": pa.array(seen[rows])}
                              | {f"w{i}": pa.array(change[:, i]) for i in range(w.shape[1])})
    return run


def _score(model, frequent):
    def run(batches):
        from pyspark import TaskContext
        m, at = model.value, TaskContext.get().partitionId() << 33
        lexicon = Lexicon(m["endings"], frequent.value, m["alpha"])
        for docs in _blocks(batches, lexicon):
            f, cls = _contexts(docs, lexicon)
            own = np.empty(f.shape[1])
            for lo in range(0, f.shape[1], BLOCK):
                own[lo:lo + BLOCK] = log_probability(m["weights"], m["bias"], f[:, lo:lo + BLOCK], cls[lo:lo + BLOCK])
            own = own / math.log(10) - m["class_log"][cls]
            out = {k: [] for k in ("n", "known", "logs", "model", "words", "times")}
            lo = 0
            for _, _, codes in docs:
                rows = lexicon.rows[codes]
                rare, times = np.unique(codes[rows[:, 1] == 0], return_counts=True)
                for k, v in zip(out, (len(codes), int(rows[:, 1].sum()), rows[:, 2].sum(), own[lo:lo + len(codes)].sum(),
                                      [lexicon.words[c] for c in rare], times)):
                    out[k].append(v)
                lo += len(codes)
            ids = pa.array([b.column("doc_id")[i].as_py() for b, i, _ in docs], docs[0][0].column("doc_id").type)
            yield pa.record_batch({
                "rk": pa.array(at + np.arange(len(docs))), "doc_id": ids, "n_tokens": pa.array(out["n"], pa.int64()),
                "known": pa.array(out["known"], pa.int64()), "logs": pa.array(out["logs"], pa.float64()),
                "model": pa.array(out["model"], pa.float64()), "words": pa.array(out["words"], pa.list_(pa.binary())),
                "times": pa.array(out["times"], pa.list_(pa.int64()))})
            at += len(docs)
    return run


def lm_scores(docs: DataFrame, classes: int = 32, alpha: float = 0.1, rounds: int = 2, rate: float = 0.4,
              frequent_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose id hash mod 10 is 0 are held out; the model learns from all others.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent-lm")
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("hash", id_hash(F.col("doc_id")))
    learn = d.filter("hash % 10 <> 0")
    counts = learn.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = scratch.write(counts, "counts")

    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total[0]), int(total[1])
    tops = counts.groupBy(F.expr("substring(word, -2, 2)").alias("ending")) \
        .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")) \
        .orderBy(F.desc("c"), "ending").limit(classes - 1).collect()
    endings = {bytes(r["ending"]): i + 1 for i, r in enumerate(tops)}
    class_n = np.array([n - sum(r["c"] for r in tops)] + [r["c"] for r in tops] + [0] * (classes - 1 - len(tops)), float)
    class_v = np.array([v - sum(r["v"] for r in tops)] + [r["v"] for r in tops] + [0] * (classes - 1 - len(tops)), float)
    # the least count of a frequent word, from the histogram of counts: at most ``frequent_words`` of them
    least, have = None, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).limit(frequent_words).collect():
        have += r["count"]
        if have > frequent_words:
            break
        least = r["c"]
    common = counts.filter(F.col("c") >= least) if least is not None else counts.limit(0)
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): r["c"] for r in common.collect()})

    model = {"weights": np.zeros((ROWS, classes), np.float32), "alpha": alpha, "endings": endings,
             "bias": np.log((class_n + 0.5) / (class_n + 0.5).sum()).astype(np.float32),
             "class_log": np.log10(class_n + alpha * (class_v + 1))}
    cols = [f"w{i}" for i in range(classes)]
    for k in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast(model)
        part = learn.filter(F.pmod(F.floor(F.col("hash") / 10), F.lit(rounds)) == k).select("text")
        changes = part.mapInArrow(_train(shared, rate), "row long, seen double, " + ", ".join(f"{c} double" for c in cols))
        got = changes.groupBy("row").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in cols]).toPandas()  # ROWS at most
        weights = model["weights"].copy()
        weights[got["row"].to_numpy(np.int64)] += got[cols].to_numpy(np.float32)
        model = model | {"weights": weights}
    shared = spark.sparkContext.broadcast(model)

    kind = d.schema["doc_id"].dataType.simpleString()
    scored = d.select("doc_id", "text").mapInArrow(
        _score(shared, frequent), f"rk long, doc_id {kind}, n_tokens long, known long, logs double, model double, "
                                  "words array<binary>, times array<long>")
    scored = scratch.write(scored, "scored")
    rare = scored.select("rk", F.explode(F.arrays_zip("words", "times")).alias("x")) \
        .select("rk", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    sums = rare.join(counts, "word", "left").groupBy("rk").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(alpha))).alias("rare_logs"))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(sums, "rk", "left").select(
        "doc_id", (id_hash(F.col("doc_id")) % 10 == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n + alpha * (v + 1))).alias("base_score"),
        (logs + F.col("model")).alias("score"))
