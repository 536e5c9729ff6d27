"""Secret scan: rules, and a character convolutional network over every other candidate.

Method
  1. One pass over the whole texts finds the rule findings (three kinds) and the
     candidates: every run of at least ``min_length`` token characters, with or
     without digits, that does not lie inside one finding; a run that is longer
     than the finding in it is a candidate as a whole.
  2. Labelled findings: rule findings are positive; candidates that no finding
     touches are negative if they are digits alone or look like words. Others, which
     mix letters and digits or cases, are what unknown secrets look like, so they are
     no labels: taken as negative they would teach the network to reject the very
     formats it is to find. The fit takes at most ``max_findings`` of each, those with
     the smallest hash (a quarter of the negatives are digits alone, if there are as
     many: plain words must not crowd them out). A second copy of each positive gets the surroundings of a negative, and
     further ones also another random value of another length, so the network
     learns the value's shape and not only the name in front of it, the alphabet
     or the length the rules know.
  3. A one-layer character CNN (width 5, ReLU, maximum over the left context, the
     candidate, the right context) next to the candidate's length and its shares
     of digits, letters of either case, other signs and changes between them; then
     a logistic output; Adam in numpy. A quarter of the sample is kept for
     calibration (Platt scaling).
  4. Every candidate of every text is scored at full length.
  5. Thresholds, per sort of value (digits; hex; mixed; plain letters in the case of
     words), on a grid of 1/512 logit. Spark scores all positives of the corpus. Two
     bounds hold: at least ``recall`` of a sort's labelled findings, in their own
     surroundings, are kept; and candidates that no finding touches are added at
     most ``max_false[sort]`` times the number of findings. Within both, the
     threshold is the largest that also keeps ``recall`` of the sort's copies and
     random values in a negative's surroundings. Where the bounds conflict, the recall
     of labelled findings holds.
  6. Candidates that reach their threshold are added as spans of kind ``extra``.
     Rule spans stay.

Defined results
  null text is empty; texts without findings have empty strings; null and
  repeated ids: every input row gets its row; empty table: empty result; without
  positives and negatives there is no network and nothing is added; other
  columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gale.llm.common import Scratch, pick

# Rules, fixed values: letters of "assign" names in either case, least length of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "extra")

LEFT, RIGHT, WIDTH, FILTERS = 24, 12, 5, 24
FIT_LENGTH = 256  # longer findings are left out of the fit, never out of the thresholds or the scan
LONG = 4096  # longer candidates are scored one by one, in pieces
GRID, MOST = 512, 64  # cells of a calibrated logit, and the logit from which on all are one cell
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'=:+/_.-@"
_CODE = np.full(128, len(ALPHABET) + 1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1  # 0: no character; the last: any other
_BYTE = _CODE.astype(np.uint8)


def rule_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value), leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _candidates(text: str, found: list[tuple[str, int, int, int]], min_length: int) -> list[tuple[int, int, bool]]:
    """(start, end, whether a finding touches it) of the runs that no finding covers."""
    runs = re.finditer(rf"[A-Za-z0-9+/_=-]{{{min_length},}}", text)
    if not found:
        return [(*m.span(), False) for m in runs]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, ends = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    out = []
    for m in runs:
        lo, hi = m.span()
        if ends[bisect_right(starts, lo)] < hi:
            out.append((lo, hi, ends[bisect_left(starts, hi)] > lo))
    return out


def candidate_spans(text: str, found: list[tuple[str, int, int, int]], min_length: int) -> list[tuple[int, int]]:
    """Runs of at least ``min_length`` token characters that do not lie inside one finding."""
    return [(lo, hi) for lo, hi, _ in _candidates(text, found, min_length)]


def encode(s: str) -> np.ndarray:
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(code < 128, _CODE[np.minimum(code, 127)], len(ALPHABET) + 1)


def encode_bytes(s: str) -> np.ndarray:
    return _BYTE[np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]


DIGITS, HEXES, MIXED, PLAIN = range(4)  # sorts of values
_PLAIN = re.compile(r"(?:[+/_=-]|(?<![A-Za-z])[A-Z]*[a-z]*(?<=[A-Za-z])(?![A-Za-z]))+", re.ASCII)


def sort_of(value: str) -> int:
    """PLAIN: no digit, and in each run of letters no capital behind a small one, like words are; DIGITS: no letter."""
    if _PLAIN.fullmatch(value):
        return PLAIN
    if re.fullmatch(r"[0-9+/_=-]+", value):
        return DIGITS
    return HEXES if re.fullmatch(r"[0-9a-fA-F]+", value) else MIXED


_CLASS = np.full(len(ALPHABET) + 2, 4)  # digit, lower, upper, joining sign, none of these
for _i, _c in enumerate(ALPHABET):
    _CLASS[_i + 1] = 0 if _c.isdigit() else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c in "+/_=-" else 4
SHAPE = 7


def shapes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, SHAPE) of ``code[start:end]``: length, shares of digits, lower and upper case and signs, changes of class, digits x letters."""
    kind = _CLASS[code]
    n = (end - start).astype(float)
    share = []
    for k in range(4):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        share.append((total[end] - total[start]) / n)
    turn = np.concatenate([[0, 0], np.cumsum(kind[1:] != kind[:-1])])  # changes before each place
    return np.stack([np.log2(n) / 8, *share, (turn[end] - turn[start + 1]) / n, 4 * share[0] * (share[1] + share[2])], 1)


def _spans_text(spans) -> str:
    order = sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


class _Smallest:
    """The different items with the smallest hashes, at most ``most``."""

    def __init__(self, most: int):
        self.most, self.items, self.bound = most, set(), 1 << 32

    def add(self, item: tuple[int, str, str, str]) -> None:
        if item[0] <= self.bound:
            self.items.add(item)
            if len(self.items) > 4 * self.most + 64:
                self.cut()

    def cut(self) -> list[tuple[int, str, str, str]]:
        kept = sorted(self.items)[:self.most]
        self.items = set(kept)
        if len(kept) == self.most:
            self.bound = kept[-1][0] if kept else -1
        return kept


def _place(left: str, value: str, right: str) -> int:
    return zlib.crc32(f"{left}\0{value}\0{right}".encode("utf-8", "surrogatepass"))


STRATUM = (0, None, None, 1)  # of the negatives, by sort; None: not labelled


def _labelled(min_length: int, quotas: tuple[int, ...]):
    """All positives; of the negatives of each stratum (0: digits, 1: plain) those with the smallest hash in the task."""
    def rows(label, stratum, items):
        place, left, value, right = zip(*items)
        return pa.record_batch({"label": pa.array([label] * len(items), pa.int32()),
                                "stratum": pa.array([stratum] * len(items), pa.int32()),
                                "place": pa.array(place, pa.int64()), "left": pa.array(left, pa.string()),
                                "value": pa.array(value, pa.string()), "right": pa.array(right, pa.string())})

    def run(batches):
        least = [_Smallest(q) for q in quotas]
        for b in batches:
            pos = []
            for t in b.column("text"):
                text = t.as_py() or ""
                found = rule_spans(text)
                for _, _, e, v in found:
                    item = text[max(0, v - LEFT):v], text[v:e], text[e:e + RIGHT]
                    pos.append((_place(*item), *item))
                for s, e, touched in _candidates(text, found, min_length):
                    stratum = STRATUM[sort_of(text[s:e])] if not touched and e - s <= FIT_LENGTH else None
                    if stratum is not None:
                        item = text[max(0, s - LEFT):s], text[s:e], text[e:e + RIGHT]
                        least[stratum].add((_place(*item), *item))
            if pos:
                yield rows(1, 0, pos)
        for k in range(len(quotas)):
            if items := least[k].cut():
                yield rows(0, k, items)
    return run


class Network:
    """Character CNN with three pooled regions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"conv": rng.normal(0, 0.3, (WIDTH, len(ALPHABET) + 2, FILTERS)), "cb": np.zeros(FILTERS),
                  "out": rng.normal(0, 0.2, 3 * FILTERS), "shape": np.zeros(SHAPE), "ob": np.zeros(1)}
        self.scale, self.shift, self.floors = 1.0, 0.0, (0, 0, 0, 0)  # floors: least cell worth keeping, by sort

    def _conv(self, x: np.ndarray) -> np.ndarray:
        """x: (n, length + WIDTH - 1) codes -> (n, length, FILTERS)."""
        n = x.shape[1] - WIDTH + 1
        return sum(self.p["conv"][w][x[:, w:w + n]] for w in range(WIDTH)) + self.p["cb"]

    @staticmethod
    def batch(items: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes padded by WIDTH // 2 on both sides, and the region of each place (3: none)."""
        most = max(len(a) + len(b) + len(c) for a, b, c in items)
        x = np.zeros((len(items), most + WIDTH - 1), np.int64)
        region = np.full((len(items), most), 3)
        for i, parts in enumerate(items):
            code = encode("".join(parts))
            x[i, WIDTH // 2:WIDTH // 2 + len(code)] = code
            region[i, :len(code)] = np.repeat([0, 1, 2], [len(s) for s in parts])
        return x, region

    def pooled(self, x: np.ndarray, region: np.ndarray):
        """ReLU maxima per region (n, 3, FILTERS) and their places."""
        z = self._conv(x)
        tops, places = [], []
        for r in range(3):
            inside = np.where((region == r)[:, :, None], z, 0.0)
            place = inside.argmax(1)
            places.append(place)
            tops.append(np.maximum(np.take_along_axis(inside, place[:, None, :], 1)[:, 0], 0))
        return np.stack(tops, 1), np.stack(places, 1)

    def logit(self, left: str, value: str, right: str) -> float:
        """One candidate at full length, in overlapping pieces."""
        best, whole = np.zeros((3, FILTERS)), [left, value, right]
        x, region = self.batch([tuple(whole)])
        for lo in range(0, region.shape[1], 4096):
            top, _ = self.pooled(x[:, lo:lo + 4096 + WIDTH - 1], region[:, lo:lo + 4096])
            best = np.maximum(best, top[0])
        return float(best.reshape(-1) @ self.p["out"] + self.shape(value) @ self.p["shape"] + self.p["ob"][0])

    @staticmethod
    def shape(value: str) -> np.ndarray:
        return shapes(encode(value), np.zeros(1, np.int64), np.full(1, len(value)))[0]

    def tables(self) -> tuple[np.ndarray, ...]:
        """The convolution as sums of looked-up rows: two characters, two characters, one with the bias."""
        c = self.p["conv"]
        two = [(c[w][:, None, :] + c[w + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32) for w in (0, 2)]
        return *two, (c[4] + self.p["cb"]).astype(np.float32), self.p["out"].astype(np.float32)

    def logits_at(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, tables) -> np.ndarray:
        """Logits of ``code[start:end]`` with their surroundings; code 0 is no character, PAD of it between texts."""
        two, more, one, weights = tables
        size, out, v = end - start, np.empty(len(start)), len(one)
        for n in np.unique(size):
            rows = np.nonzero(size == n)[0]
            step = max(1, (1 << 14) // (LEFT + int(n) + RIGHT))
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                x = code[start[part][:, None] + np.arange(-LEFT - 2, n + RIGHT + 2)].astype(np.intp)
                x[:, :2] = x[:, -2:] = 0
                z = two.take(x[:, :-4] * v + x[:, 1:-3], 0)
                z += more.take(x[:, 2:-2] * v + x[:, 3:-1], 0)
                z += one.take(x[:, 4:], 0)
                none = x[:, 2:-2] == 0
                if none.any():
                    z[none] = 0
                top = np.stack([z[:, :LEFT].max(1), z[:, LEFT:LEFT + n].max(1), z[:, LEFT + n:].max(1)], 1)
                out[part] = (np.maximum(top, 0).reshape(len(part), -1) * weights).sum(1)
        return out + shapes(code, start, end) @ self.p["shape"] + self.p["ob"][0]

    def logits(self, items: list[tuple[str, str, str]], tables=None) -> np.ndarray:
        out, short = np.empty(len(items)), [i for i, x in enumerate(items) if len(x[1]) <= LONG]
        for i, x in enumerate(items):
            if len(x[1]) > LONG:
                out[i] = self.logit(*x)
        if short:
            code, at = joined(["".join(items[i]) for i in short])
            start = at + np.array([len(items[i][0]) for i in short])
            out[short] = self.logits_at(code, start, start + np.array([len(items[i][1]) for i in short]),
                                        tables or self.tables())
        return out

    def cells(self, logit: np.ndarray) -> np.ndarray:
        """Calibrated logits on the grid the thresholds use."""
        return np.floor(np.clip(self.scale * logit + self.shift, -MOST, MOST) * GRID).astype(np.int64)

    def fit(self, items: list[tuple[str, str, str]], y: np.ndarray, epochs: int = 8, rate: float = 5e-3) -> None:
        rng = np.random.default_rng(3)
        m, v, t = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(items)), max(1, len(items) // 64)):
                x, region = self.batch([items[i] for i in part])
                top, place = self.pooled(x, region)
                form = np.stack([self.shape(items[i][1]) for i in part])
                flat, t = top.reshape(len(part), -1), t + 1
                e = (1 / (1 + np.exp(-(flat @ self.p["out"] + form @ self.p["shape"] + self.p["ob"]))) - y[part]) / len(part)
                back = (e[:, None] * self.p["out"]).reshape(top.shape) * (top > 0)
                conv = np.zeros_like(self.p["conv"])
                row, reg, k = np.nonzero(back)
                for w in range(WIDTH):
                    np.add.at(conv[w], (x[row, place[row, reg, k] + w], k), back[row, reg, k])
                grad = {"conv": conv, "cb": back.sum((0, 1)), "out": flat.T @ e + 1e-4 * self.p["out"], "shape": form.T @ e, "ob": e.sum()}
                for name in self.p:
                    m[name] = 0.9 * m[name] + 0.1 * grad[name]
                    v[name] = 0.999 * v[name] + 0.001 * grad[name] ** 2
                    self.p[name] = self.p[name] - rate * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v[name] / (1 - 0.999 ** t)) + 1e-8)

    def calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps on smoothed targets."""
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -500, 500)))
            d, w = p - goal, p * (1 - p) + 1e-9
            g = np.array([d @ logit, d.sum()]) + 1e-3 * np.array([a - 1, b])
            h = np.array([[w @ (logit * logit), w @ logit], [w @ logit, w.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(max(a, 1e-3)), float(b)


HEX_DIGITS = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_DRAWN = ("0123456789", HEX_DIGITS, LETTERS, "abcdefghijklmnopqrstuvwxyz")  # alphabets by sort


def recoded(value: str, seed: int, sort: int = MIXED) -> str:
    """Another random value of a sort, half of them of 8 to 12 characters, half of 8 to the
    value's length; of the mixed ones every third has a short word and a sign in front, as
    issued keys do."""
    rng = np.random.default_rng([seed, sort])
    size = int(rng.integers(8, 13 if rng.random() < 0.5 else max(len(value), 12) + 1))
    for _ in range(64):
        out = "".join(_DRAWN[sort][k] for k in rng.integers(0, len(_DRAWN[sort]), size).tolist())
        if sort_of(out) == sort:
            break
    if sort == MIXED and seed % 3 == 0:
        word = "".join(_DRAWN[PLAIN][k] for k in rng.integers(0, 26, int(rng.integers(2, 6))).tolist())
        out = word + "_-"[seed % 2] + out
    return out


OWN, MOVED, RANDOM = range(3)  # labelled findings, the same in a negative's surroundings, random values there


def _keeping(rows: list[tuple[int, int]], recall: float) -> int | None:
    """The largest cell that keeps ``recall`` of (cell, number) rows."""
    miss = math.floor((1 - recall) * sum(n for _, n in rows))
    for cell, n in sorted(rows):
        miss -= n
        if miss < 0:
            return cell
    return None


def wanted(counts: list[tuple[int, int, int, int]], recall: float) -> list[tuple[int, int | None]]:
    """By sort: the largest cell that keeps ``recall`` of its copies and of its random
    values, and the one that keeps it of its labelled findings (None: it has none). ``counts``: (OWN, MOVED or RANDOM; sort; cell; number)."""
    out = []
    for sort in range(4):
        of = [[(c, n) for w, s, c, n in counts if w == which and s == sort] for which in range(3)]
        goals = [_keeping(rows, recall) for rows in (of[OWN] + of[MOVED], of[RANDOM]) if rows]
        out.append((min(goals), _keeping(of[OWN], recall) if of[OWN] else None))
    return out


def thresholds(goals: list[tuple[int, int | None]], untouched: list[tuple[int, int, int]], findings: int,
               max_false: tuple[float, ...]) -> tuple[int, ...]:
    """By sort: the goal, raised until at most ``max_false * findings`` of the ``untouched``
    candidates (sort, cell, number) reach it, but never above what the labelled findings need."""
    out = []
    for sort, (goal, own) in enumerate(goals):
        left, cell = math.floor(max_false[sort] * findings), MOST * GRID + 1
        for c, n in sorted(((c, n) for s, c, n in untouched if s == sort and c >= goal), reverse=True):
            left -= n
            if left < 0:
                break
            cell = c
        else:
            cell = goal
        out.append(cell if own is None else min(cell, own))
    return tuple(out)


PAD = max(LEFT, RIGHT) + WIDTH // 2


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with PAD empty places around each, and where each begins."""
    codes = [encode_bytes(t) for t in texts]
    at = np.cumsum([0] + [len(c) + PAD for c in codes])[:-1] + PAD
    gap = np.zeros(PAD, np.uint8)
    return np.concatenate([gap] + [x for c in codes for x in (c, gap)]), at


def train(sample) -> Network | None:
    """Network from rows (label, left, value, right, kept for calibration)."""
    pos = [r for r in sample if r["label"] == 1]
    neg = [r for r in sample if r["label"] == 0]
    if not pos or not neg:
        return None
    rng = np.random.default_rng(11)
    rows = [((r["left"], r["value"], r["right"]), r["label"], r["kept"]) for r in pos + neg]
    for r in pos:
        other = neg[rng.integers(len(neg))]
        rows.append(((other["left"], r["value"], other["right"]), 1, r["kept"]))
        for sort in (HEXES, MIXED, MIXED):
            other = neg[rng.integers(len(neg))]
            rows.append(((other["left"], recoded(r["value"], int(rng.integers(1 << 30)), sort), other["right"]), 1, r["kept"]))
    kept = np.array([r[2] for r in rows], bool)
    y = np.array([r[1] for r in rows], float)
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept = np.ones(len(rows), bool)
        fit = np.arange(len(rows))
    else:
        fit = np.nonzero(~kept)[0]
    net = Network()
    net.fit([rows[i][0] for i in fit], y[fit])
    held = np.nonzero(kept)[0]
    items = [rows[i][0] for i in held]
    net.calibrate(net.logits(items), y[held])
    return net


def _positive_cells(shared):
    """(which, sort, cell) of every positive: in its own surroundings, in those of a negative, and a random value of each sort there."""
    def run(batches):
        net, around = shared.value
        tables = net.tables()
        for b in batches:
            which, items = [], []
            for left, value, right, place in zip(*(b.column(c).to_pylist() for c in ("left", "value", "right", "place"))):
                made = [value] + [recoded(value, place, sort) for sort in range(4)]
                which += [OWN, MOVED] + [RANDOM] * 4
                items.append((left, value, right))
                for k, v in enumerate(made):
                    other = around[zlib.crc32(place.to_bytes(8, "little"), k) % len(around)]
                    items.append((other[0], v, other[1]))
            yield pa.record_batch({"which": pa.array(which, pa.int32()), "sort": pa.array([sort_of(i[1]) for i in items], pa.int32()),
                                   "cell": pa.array(net.cells(net.logits(items, tables)) if items else [], pa.int64())})
    return run


def _groups(column, most: int = 1 << 20):
    """Texts in groups of at most about ``most`` characters."""
    out, n = [], 0
    for t in column:
        out.append(t.as_py() or "")
        n += len(out[-1])
        if n > most:
            yield out
            out, n = [], 0
    if out:
        yield out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sort", pa.int32()),
                            ("cell", pa.int64()), ("touched", pa.bool_())]))


def _judge(shared, min_length: int):
    """The rule spans of every text, and its candidates that reach the floor of their sort, in the order of spans."""
    def run(batches):
        net = shared.value
        tables = net.tables() if net is not None else None
        for b in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "sha", "spans")}
            for texts in _groups(b.column("text")):
                all_found = [rule_spans(t) for t in texts]
                extra = _scored(net, tables, texts, all_found, min_length) if net is not None else {}
                for i, found in enumerate(all_found):
                    for kind in KINDS[:3]:
                        rows[f"n_{kind}"].append(sum(x[0] == kind for x in found))
                    rows["sha"].append(hashlib.sha256(_spans_text([x[:3] for x in found]).encode()).hexdigest())
                    spans = [(k, s, e, None, None, None) for k, s, e, _ in found] + extra.get(i, [])
                    spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    rows["spans"].append([dict(zip(("kind", "start", "end", "sort", "cell", "touched"), x)) for x in spans])
            yield pa.record_batch({"doc_id": b.column("doc_id")} | {
                f"n_{k}": pa.array(rows[f"n_{k}"], pa.int64()) for k in KINDS[:3]} | {
                "base_sha256": pa.array(rows["sha"], pa.string()), "found": pa.array(rows["spans"], SPANS)})
    return run


def _scored(net: Network, tables, texts: list[str], all_found, min_length: int) -> dict[int, list[tuple]]:
    """The candidates of each text (by its number) that reach the floor of their sort."""
    spans = [(i, lo, hi, t) for i, (text, f) in enumerate(zip(texts, all_found)) for lo, hi, t in _candidates(text, f, min_length)]
    if not spans:
        return {}
    code, at = joined(texts)
    doc, lo, hi, _ = np.array(spans, np.int64).T
    logit, short = np.empty(len(spans)), hi - lo <= LONG
    logit[short] = net.logits_at(code, (at[doc] + lo)[short], (at[doc] + hi)[short], tables)
    for k in np.nonzero(~short)[0]:
        i, s, e, _ = spans[k]
        logit[k] = net.logit(texts[i][max(0, s - LEFT):s], texts[i][s:e], texts[i][e:e + RIGHT])
    cell, out = net.cells(logit), {}
    for k in np.nonzero(cell >= min(net.floors))[0]:
        i, s, e, touched = spans[k]
        sort = sort_of(texts[i][s:e])
        if cell[k] >= net.floors[sort]:
            out.setdefault(i, []).append(("extra", s, e, sort, int(cell[k]), touched))
    return out


def fitted(docs: DataFrame, scratch: Scratch, min_length: int, max_findings: int, recall: float):
    """The network and the goals of its thresholds, by sort; (None, None) without labels. ``docs``: a text column."""
    spark, part = docs.sparkSession, max_findings // 4
    quotas = (part, max_findings - part)
    found = docs.select("text").mapInArrow(_labelled(min_length, quotas), "label int, stratum int, place long, "
                                                                          "left string, value string, right string")
    found = scratch.write(found, "labelled")
    order = ["place", "left", "value", "right"]
    fit = found.filter(F.length("value") <= FIT_LENGTH).distinct()
    sample = [r.asDict() for label, stratum, most in [(1, 0, max_findings), *((0, k, q) for k, q in enumerate(quotas))]
              for r in fit.filter((F.col("label") == label) & (F.col("stratum") == stratum)).orderBy(*order).limit(most)
              .withColumn("kept", F.col("place") % 4 == 0).collect()]
    net, goals = train(sample), None
    if net is not None:
        around = [(r["left"], r["right"]) for r in sample if r["label"] == 0]
        shared = spark.sparkContext.broadcast((net, around))
        cells = found.filter("label = 1").select("left", "value", "right", "place") \
            .mapInArrow(_positive_cells(shared), "which int, sort int, cell long")
        counts = cells.groupBy("which", "sort", "cell").count().collect()  # 12 x (2 * MOST * GRID + 1) cells at most
        goals = wanted([tuple(r) for r in counts], recall)
        net.floors = tuple(goal if own is None else min(goal, own) for goal, own in goals)
    scratch.drop("labelled")
    return net, goals


def scan_secrets(docs: DataFrame, min_length: int = 8, max_findings: int = 2000, recall: float = 0.98,
                 max_false: tuple[float, ...] = (0.05, 1.0, 1.0, 0.05), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_extra.

    ``max_false``: added spans that no finding touches, for each finding of the corpus, by sort of value."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    net, goals = fitted(d, scratch, min_length, max_findings, recall)
    judged = scratch.write(d.mapInArrow(
        _judge(spark.sparkContext.broadcast(net), min_length),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<"
        "kind: string, start: long, end: long, sort: int, cell: long, touched: boolean>>"), "judged")
    least = (MOST * GRID + 1,) * 4
    if net is not None:
        findings = judged.agg(F.coalesce(F.sum(F.expr("n_assign + n_access + n_hex")), F.lit(0))).first()[0]
        untouched = judged.select(F.explode("found").alias("x")).filter("NOT x.touched") \
            .groupBy("x.sort", "x.cell").count().collect()  # 4 x (2 * MOST * GRID + 1) cells at most
        least = thresholds(goals, [tuple(r) for r in untouched], findings, max_false)
    bounds = F.array(*[F.lit(t).cast("long") for t in least])
    kept = F.filter("found", lambda x: x["cell"].isNull() | (x["cell"] >= F.element_at(bounds, x["sort"] + 1)))
    out = judged.withColumn("found", kept)
    text = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"),
                      F.size(F.filter("found", lambda x: x["cell"].isNotNull())).cast("long").alias("n_extra"))
