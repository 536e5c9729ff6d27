"""Case-record files as a Spark data source.

A record starts at a line whose last token is ``HEAD`` and ends at a line whose
last token is ``LAST``. The planner lists the files and cuts them at byte
offsets; a reader skips to the first line that starts inside its range and owns
the records whose header line starts there, reading past the end of the range to
complete the last one. So any cut gives the same rows, a large file is read by
many tasks, and marker letters inside names or other tokens mean nothing.

``case_records(spark, paths, predictors)`` is the way in; with the format itself::

    spark.dataSource.register(CaseRecordSource)
    spark.read.format("case_records").option("predictors", "VMAX,SHRG").load(path)

One row per record: header tokens, and per wanted predictor its values (an array
of 23, the first two empty where the line starts at hour 0) and its age token;
lines of predictors that are not wanted are not split into tokens.

Paths may be files, folders (read recursively; names starting with ``_`` or ``.``
are skipped) and globs, on any file system that pyarrow opens by its URI (local,
hdfs, viewfs, s3, gs). Compressed files (.gz, .bz2, .zst, .lz4) are one range.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# --- Fixed values: record layout ---------------------------------------------
N_STEPS = 23            # -12 h .. +120 h every 6 h
HEADER = {"name": 0, "yymmdd": 1, "hh": 2, "atcf_id": 7}  # places in the header line
# tokens of a predictor line -> (empty steps in front, whether an age token ends it)
LINE_LAYOUTS = {24: (0, False), 25: (0, True), 22: (2, False), 23: (2, True)}
# ---------------------------------------------------------------------------

SPLIT_BYTES = 32 << 20  # of one task
OPEN_BYTES = 1 << 20    # what opening a file costs, in bytes read
PACKED_RATIO = 8        # bytes of text in a byte of a compressed file, about
ROWS = 512              # records of one Arrow batch
_PACKED = (".gz", ".bz2", ".zst", ".lz4")
_BOM = b"\xef\xbb\xbf"
_WHITE = b"\t\n\r\x0b\x0c"  # white space other than blanks


def file_system(path: str):
    """(file system, path inside it) of a path or URI."""
    from pyarrow import fs
    if m := re.match(r"file:/+", path):
        path = "/" + path[m.end():]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def list_files(path: str, name_glob: str | None = None) -> list[tuple[str, int]]:
    """(path inside the file system, size) of every file under a path, folder or glob, sorted."""
    from pyarrow import fs
    system, inside = file_system(path)
    parts = inside.split("/")
    fixed = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    base, wild = "/".join(parts[:fixed]) or "/", parts[fixed:]
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
    out = []
    for f in infos:
        if f.type != fs.FileType.File:
            continue
        rest = [p for p in f.path[len(base):].split("/") if p]
        if len(rest) < len(wild) or not all(fnmatchcase(p, w) for p, w in zip(rest, wild)):
            continue
        if any(p[0] in "_." for p in rest) or (name_glob and not fnmatchcase(f.base_name, name_glob)):
            continue
        out.append((f.path, f.size))
    return sorted(out)


class Ranges(InputPartition):
    """Byte ranges (root path, file, start, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, str, int, int]]):
        super().__init__(len(ranges))
        self.ranges = ranges


def plan_ranges(files: list[tuple[str, str, int]], split_bytes: int) -> list[list[tuple[str, str, int, int]]]:
    """Files (root, path, size) cut at ``split_bytes``; small ones share a task."""
    cuts = []
    for root, path, size in files:
        step = size if path.endswith(_PACKED) else split_bytes
        cuts += [(root, path, lo, min(lo + step, size)) for lo in range(0, size, max(step, 1))]
    out, room = [], 0
    for cut in cuts:
        size = (cut[3] - cut[2]) * (PACKED_RATIO if cut[1].endswith(_PACKED) else 1)
        cost = min(size + min(OPEN_BYTES, split_bytes), split_bytes)
        if cost > room:
            out.append([])
            room = split_bytes
        out[-1].append(cut)
        room -= cost
    return out


def raw_records(stream, start: int, end: int | None, wanted: frozenset[bytes]) -> Iterator[tuple[int, list[bytes], dict]]:
    """(offset, header tokens, {predictor: (values, one blank between them; age)}) of the records
    whose header starts in [start, end). ``stream`` is at ``start`` - 1, or at 0 if ``start`` is 0.

    The last header before a ``LAST`` counts, of lines of one predictor the last;
    lines that are neither a marker nor have a layout's number of tokens are skipped."""
    at = start
    if start:
        at += len(stream.readline()) - 1  # the rest of a line that starts before the range
    head, begun, lines = None, 0, {}
    readline, layouts = stream.readline, LINE_LAYOUTS.get
    while True:
        if head is None and end is not None and at >= end:
            return
        line = readline()
        if not line:
            return
        here, at = at, at + len(line)
        if not here and line.startswith(_BOM):
            line = line[3:]
        tail = line.rsplit(None, 2)
        if not tail:
            continue
        last = tail[-1]
        if last == b"HEAD":
            if end is not None and here >= end:
                return  # the next range's record; the one before it had no end
            head, begun, lines = line.split(), here, {}
        elif head is None:
            continue
        elif last == b"LAST":
            yield begun, head, lines
            head = None
        elif last in wanted or (len(tail) > 1 and tail[-2] in wanted):
            text = line.strip()
            if b"  " in text or len(text.translate(None, _WHITE)) < len(text):
                text = b" ".join(text.split())
            layout = layouts(text.count(b" ") + 1)
            if layout is None:
                continue
            pad, aged = layout
            name, rest = (tail[-2], len(last) + len(tail[-2]) + 2) if aged else (last, len(last) + 1)
            if name in wanted:
                lines[name] = (b" " * pad + text[:-rest], last if aged else None)


def read_records(stream, start: int, end: int | None, wanted: frozenset[bytes]) -> Iterator[tuple[int, list[bytes], dict]]:
    """:func:`raw_records` with the values as lists."""
    for begun, head, lines in raw_records(stream, start, end, wanted):
        yield begun, head, {name: (values.split(b" "), age) for name, (values, age) in lines.items()}


def _text(token: bytes | None) -> str | None:
    return None if token is None else token.decode("utf-8", "replace")


class CaseRecordReader(DataSourceReader):
    def __init__(self, options: dict, predictors: list[str], ages: list[str]):
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.name_glob = options.get("pathglobfilter")
        self.predictors, self.ages = predictors, ages

    def partitions(self):
        files = {(path, size): root for root in self.roots for path, size in list_files(root, self.name_glob)}
        return [Ranges(r) for r in plan_ranges([(root, *f) for f, root in sorted(files.items())], self.split_bytes)]

    def read(self, partition):
        wanted = frozenset(p.encode() for p in {*self.predictors, *self.ages})
        rows = []
        for root, path, start, end in partition.ranges if partition is not None else []:
            system, _ = file_system(root)
            packed = path.endswith(_PACKED)
            with system.open_input_stream(path, compression="detect", buffer_size=1 << 20) if packed else system.open_input_file(path) as raw:
                if not packed:
                    raw.seek(max(start - 1, 0))
                for record in raw_records(_Lines(raw), 0 if packed else start, None if packed else end, wanted):
                    rows.append((path, *record))
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        def header(place):
            return pa.array([_text(h[place]) if len(h) > place else None for _, _, h, _ in rows], pa.string())
        cols = {"path": pa.array([r[0] for r in rows], pa.string()), "offset": pa.array([r[1] for r in rows], pa.int64())}
        cols |= {c: header(place) for c, place in HEADER.items()}
        for p in self.predictors:
            key = p.encode()
            # a line's values stay one string until Arrow splits them
            cols[p] = pc.split_pattern(pa.array([_text(r[3][key][0]) if key in r[3] else None for r in rows], pa.string()), " ")
        for p in self.ages:
            key = p.encode()
            cols[f"{p}_AGE"] = pa.array([_text(r[3][key][1]) if key in r[3] else None for r in rows], pa.string())
        return pa.record_batch(cols)


class _Lines:
    """Lines of a stream in blocks: ``readline`` without a call of the stream per line."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.lines, self.rest, self.at = raw, block, [], b"", 0

    def readline(self) -> bytes:
        while self.at >= len(self.lines):
            data = self.raw.read(self.block)
            if not data:
                line, self.rest = self.rest, b""
                return line
            parts = (self.rest + data).split(b"\n")
            self.rest, self.lines, self.at = parts.pop(), parts, 0
        self.at += 1
        return self.lines[self.at - 1] + b"\n"


class CaseRecordSource(DataSource):
    """Options: ``predictors`` and ``ages`` (names joined by commas), ``paths`` (a JSON list, instead
    of ``load(path)``), ``splitBytes``, ``pathGlobFilter`` (on file names)."""

    @classmethod
    def name(cls):
        return "case_records"

    def _names(self, option: str) -> list[str]:
        return [p for p in self.options.get(option, "").split(",") if p]

    def schema(self):
        cols = ["path string", "offset long", *[f"{c} string" for c in HEADER]]
        cols += [f"`{p}` array<string>" for p in self._names("predictors")]
        return ", ".join(cols + [f"`{p}_AGE` string" for p in self._names("ages")])

    def reader(self, schema):
        return CaseRecordReader({k.lower(): v for k, v in self.options.items()}, self._names("predictors"), self._names("ages"))


def case_records(spark: SparkSession, paths: str | list[str], predictors: list[str], *, ages: list[str] | None = None,
                 path_glob: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the files: path, offset, name, yymmdd, hh, atcf_id, a value array per predictor, ``<p>_AGE``."""
    spark.dataSource.register(CaseRecordSource)
    reader = spark.read.format("case_records").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))) \
        .option("predictors", ",".join(predictors)).option("ages", ",".join(ages or [])).option("splitBytes", split_bytes)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load()
