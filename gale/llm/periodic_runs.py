"""Periodic runs of words: an online sparse dynamic programme over diagonals.

A run is a stretch of consecutive words whose smallest period is q, that has at
least ``max(min_words, min_exponent * q)`` words and that no neighbouring word
extends keeping period q.

Method
  Word i and an earlier occurrence of it at i - p lie on the diagonal of lag p.
  Words are read in order; the earlier occurrences of a word increment the match
  lengths of their lags, a lag without one ends, and a diagonal that ends with
  enough matches emits its run at once.

  The programme is sparse: a diagonal matters only if it reaches
  ``max(min_words - p, (min_exponent - 1) * p)`` matches, so the earlier
  occurrences are those of the last m words, m being what the shortest run of the
  lags ``[lo, hi)`` needs. Bounds are chosen so that two lags below hi never sum
  to more than m: then, if the last m words occur at two of these distances, both
  are multiples of a smaller period of the same stretch (Fine and Wilf). So the
  *nearest* earlier occurrence is the only lag of its range that can carry a run,
  a word increments at most one lag a range, and a text of n words takes
  O(n log^2 n) steps however often its words repeat. Names of m words come from
  names of 2^k words, by sorting: equal names are equal words, not equal hashes.

Defined results
  null text has no words and no runs; a null id is read as empty text by
  ``rewrite``; repeated rows each get their row; empty table: empty result; other
  columns are ignored, clashing names too.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gale.llm.common import Scratch, pick


def _names(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def lag_ranges(n: int, min_words: int, min_exponent: int):
    """(lo, hi, m): lags of a range and the matches that a run of one of them has at least."""
    lo = 1
    while max(min_words, min_exponent * lo) <= n:
        hi = max(lo + 1, ((min_exponent - 1) * lo + 3) // 2)
        turn = min(max(lo, min_words // min_exponent), hi - 1)  # below it fewer words are needed as lags grow, above it more
        yield lo, hi, min(max(min_words - q, (min_exponent - 1) * q) for q in (turn, min(turn + 1, hi - 1)))
        lo = hi


def occurrences(ids: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(i, lag, m) in the order of i: the last m words up to word i occurred ``lag``
    words earlier, no nearer, and lag is in the range that belongs to m."""
    n, found = len(ids), []
    names = [ids.astype(np.int64)]  # the k-th: of the 2^k words that start at a position
    ends, before = None, 0
    for lo, hi, m in lag_ranges(n, min_words, min_exponent):
        if ends is not None and not len(ends) and m >= before:
            continue  # nothing repeats the fewer words of an earlier range
        k = m.bit_length() - 1
        while len(names) <= k:
            width = 1 << len(names) - 1
            names.append(_names(names[-1][:-width] * n + names[-1][width:]))
        if ends is None or m < before:
            ends = np.arange(m - 1, n)
        ends, before = ends[ends >= m - 1], m
        code = names[k][ends - m + 1] * n + names[k][ends - (1 << k) + 1]
        order = np.argsort(code, kind="stable")
        at, same = ends[order], np.diff(code[order]) == 0
        lag = np.diff(at)
        hit = same & (lag >= lo) & (lag < hi)
        found += zip(at[1:][hit].tolist(), lag[hit].tolist(), [m] * int(hit.sum()))
        # only what repeats m words can repeat more of them
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        ends = np.sort(at[again])
    found.sort()
    return found


def runs(ids: np.ndarray, min_words: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``, by start, then period."""
    if min_exponent < 3:
        raise ValueError("min_exponent: 3 or more")
    out, active = [], {}  # active: lag -> [first matching word, last one]

    def end(lag: int) -> None:
        first, last = active.pop(lag)
        length = last - first + 1 + lag
        if length >= max(min_words, min_exponent * lag):
            out.append((first - lag, length, lag))

    for i, lag, m in occurrences(ids, min_words, min_exponent):
        for ended in [p for p, (_, last) in active.items() if last < i - 1]:
            end(ended)
        if lag in active:
            active[lag][1] = i
        else:
            active[lag] = [i - m + 1, i]
    for lag in list(active):
        end(lag)
    return sorted(out)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those after the first period of a run."""
    if not found:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def repeat_tail(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The contract's planted periods: in a tenth of the documents, the words from
    ``a`` on repeat the first ``p`` of them."""
    h, n = crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _scan(min_words: int, min_exponent: int, rewrite: Callable | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            rows, sizes, texts = [], [], []
            for doc_id, text in zip(ids.to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()  # bytes: exactly the six ASCII white-space characters
                if rewrite is not None:
                    words = rewrite("" if doc_id is None else str(doc_id), words)
                number: dict[bytes, int] = {}
                found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64),
                             min_words, min_exponent) if len(words) >= min_words else []
                rows.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                sizes.append(len(words))
                texts.append(collapsed(words, found))
            yield pa.record_batch({"doc_id": ids, "n_words": pa.array(sizes, pa.int64()), "runs": pa.array(rows, kind),
                                   "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})
    return run


def find_runs(docs: DataFrame, min_words: int = 6, min_exponent: int = 4,
              rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period by start,
    then period; words numbered from 0) and ``collapsed``, the text with every run
    cut to its first period. ``rewrite(id, words)`` may change the words first."""
    Scratch(docs.sparkSession, "runs")  # holds the Arrow batches of whole texts small
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scan(min_words, min_exponent, rewrite),
                        f"doc_id {kind}, n_words long, "
                        "runs array<struct<start: long, length: long, period: long>>, collapsed string")
