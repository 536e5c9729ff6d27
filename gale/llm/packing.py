"""Concatenate and cut: documents as one token stream, cut in fixed windows.

Method (two passes)
  1. Every task tokenizes its partition and writes, per document, the ids and
     the number of tokens before it in that partition; a partition's total is
     the only thing that leaves it. A prefix sum over those totals (one small
     row per partition) gives every partition's global offset.
  2. A document's global position is offset + tokens before it, so each row is
     cut at the multiples of ``window`` on its own: a piece that ends at a
     window's border is followed by a boundary record in the next sequence.
     No rows are moved or ordered for this; the written table fixes the order,
     so a lost task is redone from the same file.

Only the last sequence is padded.

Defined results
  null or empty text: the end id alone (one piece of length 1); null and
  repeated ids: every input row is its own document; very long texts: as many
  pieces as windows they touch; empty table: no pieces; other columns are
  ignored.

Where the tokenizer file says that its pre-tokenizer never joins characters across
white space (:func:`splits_at_space`), texts are encoded by words with a bounded cache
per worker (tested against whole-text encoding); words of letters, which are one
pre-token, go straight to the merges. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gale.llm.common import Scratch, pick

CACHE_WORDS = 800_000  # per Python worker
LONG_WORD = 64         # bytes; longer words are not kept
# lower-case ASCII and Latin-1 letters in UTF-8: one pre-token, nothing left for the normalizer
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_MARKS = b".,;:!?%$&#*|"
# the byte-level alphabet: bytes that are no printable Latin-1 character stand from 256 on
_OTHER_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def splits_at_space(path: str) -> bool:
    """Whether the file's steps are known to treat the pieces between ASCII white space
    one by one: no normalizer that looks across it, a first pre-tokenizer that removes it,
    and no template, truncation or padding around the text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part, name):
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]
    normal = all(n["type"] in ("NFC", "NFD", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
                 for n in steps(spec.get("normalizer"), "normalizers"))
    before = steps(spec.get("pre_tokenizer"), "pretokenizers")
    split = bool(before) and before[0]["type"] == "Split" and before[0]["behavior"] == "Removed" and before[0]["invert"] is True \
        and r"[^\s" in before[0]["pattern"].get("Regex", "") and not re.search(r"(?<!\[\^)\\s", before[0]["pattern"]["Regex"])
    plain = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p.get("use_regex", True) for p in before[1:])
    tokens = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in spec.get("added_tokens") or [])
    return normal and split and plain and tokens and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))


class _Words(dict):
    """word (UTF-8) -> bytes of its ids; emptied when full."""

    def __init__(self, tokenizer, dtype: str, size: int, by_merges: bool):
        super().__init__()
        self.dtype, self.size, self.encode, self.merge, self.by_merges = dtype, size, tokenizer.encode, tokenizer.model.tokenize, by_merges

    def __missing__(self, word: bytes) -> bytes:
        # letters and the marks behind them are separate pre-tokens
        stem = word.rstrip(_MARKS) if self.by_merges else b""
        if not stem or not _LETTERS.fullmatch(stem):
            ids = np.array(self.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        elif stem != word:
            ids = self[stem] + self[word[len(stem):]]
        else:  # one pre-token: only the merges are left to do
            name = word.decode("latin-1").translate(_OTHER_BYTES)
            ids = np.array([t.id for t in self.merge(name)], self.dtype).tobytes()
        if len(self) >= self.size:
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class Texts:
    """Encodes lists of UTF-8 texts; ids are little-endian, 16 bits wide if the vocabulary allows, else 32."""

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer, self.by_word = Tokenizer.from_file(path), splits_at_space(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        # the short ways need lower-casing, a byte-level alphabet and letters as one pre-token
        steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        self.lowers = self.by_word and '"Lowercase"' in steps
        letters = r"[\p{L}]+" in ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
        self.words = _Words(self.tokenizer, self.dtype, size, self.lowers and letters and '"ByteLevel"' in steps)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes()
                    for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        get = self.words.__getitem__
        # fewer different words in lower case; a special token's own spelling (in <| |>) must not be touched
        return [b"".join(map(get, (t.lower() if self.lowers and b"<" not in t else t).split())) for t in texts]


@functools.cache
def _texts_of_worker(path: str) -> Texts:
    """One cache per Python worker: tasks that follow each other in it share the words."""
    return Texts(path)


def _tokenizer(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        pid, before, coder = TaskContext.get().partitionId(), 0, _texts_of_worker(path)
        end, wide = np.array([end_id], coder.dtype).tobytes(), np.dtype(coder.dtype).itemsize
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lo in range(0, b.num_rows, 512):
                part = [t + end for t in coder.encode([t or b"" for t in texts.slice(lo, 512).to_pylist()])]
                n = np.array([len(x) // wide for x in part], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(lo, 512), "part": pa.array([pid] * len(n), pa.int32()),
                    "before": pa.array(at), "n_tokens": pa.array(n), "ids": pa.array(part, pa.binary())})
    return run


def tokenize(docs: DataFrame, scratch: Scratch, tokenizer_path: str, end_id: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1: the written token table (doc_id, part, before, n_tokens, ids)."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.mapInArrow(_tokenizer(tokenizer_path, end_id),
                        f"doc_id {kind}, part int, before long, n_tokens long, ids binary")
    return scratch.write(rows, "tokens")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """Prefix sum over the partitions' totals: part -> global offset of its first token."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return totals.select("part", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))


def _cutter(window: int):
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("row", "start", "length", "crc", "seq", "offset", "ids")}
            at = np.asarray(b.column("base")) + np.asarray(b.column("before"))
            n, ids = np.asarray(b.column("n_tokens")), b.column("ids")
            for i in range(b.num_rows):
                own = np.frombuffer(ids[i].as_buffer(), "<u2" if len(ids[i].as_buffer()) == 2 * n[i] else "<u4").astype("<u4")
                g, end = int(at[i]), int(at[i] + n[i])
                while g < end:
                    stop = min(end, (g // window + 1) * window)
                    lo = g - int(at[i])
                    piece = own[lo:lo + stop - g].tobytes()
                    for k, v in zip(out, (i, lo, stop - g, zlib.crc32(piece), g // window, g % window, piece)):
                        out[k].append(v)
                    g = stop
            rows = pa.array(out["row"], pa.int64())
            yield pa.record_batch({
                "doc_id": b.column("doc_id").take(rows), "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["crc"], pa.int64()),
                "doc_tokens": b.column("n_tokens").take(rows),
                "sequence_id": pa.array(out["seq"], pa.int64()), "offset": pa.array(out["offset"], pa.int64()),
                "ids": pa.array(out["ids"], pa.binary())})
    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit), boundary (it continues in the
    next sequence)."""
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = tokenize(docs, scratch, tokenizer_path, end_id, id_col, text_col)
    offsets = scratch.write(partition_offsets(tokens), "offsets")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    placed = tokens.join(F.broadcast(offsets), "part")  # one row per written partition
    pieces = placed.select("doc_id", "base", "before", "n_tokens", "ids").mapInArrow(
        _cutter(window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                         "sequence_id long, offset long, ids binary")
    return pieces.withColumn("boundary", F.col("start") + F.col("length") < F.col("doc_tokens"))
