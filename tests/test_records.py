"""The case-record source: any cut of the files gives the same rows, markers count as tokens only."""

import gzip
import io
import random

from gale.sources import diagnostics
from gale.sources.records import ROWS, CaseRecordReader, Ranges, case_records, list_files, plan_ranges, raw_records, read_records
from tests.test_readers import _record, _series

WANTED = frozenset([b"VMAX", b"ASTX", b"RSST"])


def body(seed, n):
    rng, lines = random.Random(seed), []
    for i in range(n):
        name = rng.choice(["ASTRIDE", "BEAST", "LASTHEAD", "ALPHA", "HEAD", "LAST"])
        rec = _record(name, "200101", "18", f"EP{i:02d}2020", [_series(i, 23, "ASTX"), "", "odd line", _series(7, 21, "BAST")])
        kind = rng.randrange(5)
        lines += rec[:-1] if kind == 0 else rec[1:] if kind == 1 else [" " * 8 + x + "  " for x in rec] if kind == 2 else rec
    return ("\n".join(lines) + ("\n" if seed % 2 else "")).encode()


def naive(data):
    """The whole file, line by line."""
    out, head, lines, at = [], None, {}, 0
    for line in data.split(b"\n"):
        here, at = at, at + len(line) + 1
        t = line.split()
        if not t:
            continue
        if t[-1] == b"HEAD":
            head, lines = (here, t), {}
        elif t[-1] == b"LAST":
            if head:
                out.append((*head, lines))
            head = None
        elif head:
            if len(t) in (24, 22) and t[-1] in WANTED:
                lines[t[-1]] = ([b""] * (24 - len(t)) + t[:-1], None)
            elif len(t) in (25, 23) and t[-2] in WANTED:
                lines[t[-2]] = ([b""] * (25 - len(t)) + t[:-2], t[-1])
    return out


def cut(data, size):
    out = []
    for lo in range(0, len(data), size):
        raw = io.BytesIO(data)
        raw.seek(max(lo - 1, 0))
        out += read_records(raw, lo, min(lo + size, len(data)), WANTED)
    return out


def test_any_cut_gives_the_same_records():
    for seed in range(4):
        data = body(seed, 12)
        want = naive(data)
        assert len(want) > 5 and {bytes(h[0]) for _, h, _ in want} > {b"ASTRIDE", b"BEAST"}
        for size in [1, 2, 3, 7, 50, 131, 1000, 4096, len(data)]:
            assert cut(data, size) == want
        for k in range(0, len(data), 97):  # two ranges, the border anywhere
            got = [r for lo, hi in ((0, k), (k, len(data))) if lo < hi for r in _range(data, lo, hi)]
            assert got == want


def _range(data, lo, hi):
    raw = io.BytesIO(data)
    raw.seek(max(lo - 1, 0))
    return read_records(raw, lo, hi, WANTED)


def test_ranges_cover_the_files_once():
    files = [("r", "a", 10), ("r", "b", 0), ("r", "c", 250), ("r", "d.gz", 900), ("r", "e", 3)]
    parts = plan_ranges(files, 100)
    assert [r[2:] for p in parts for r in p if r[1] == "c"] == [(0, 100), (100, 200), (200, 250)]
    assert [r[2:] for p in parts for r in p if r[1] == "d.gz"] == [(0, 900)]
    small = plan_ranges([("r", f"f{i}", 100_000) for i in range(100)], 32 << 20)
    assert sum(map(len, small)) == 100 and 1 < len(small) <= 5
    assert plan_ranges([], 100) == [] and Ranges([]).ranges == []


def test_marker_letters_in_names(spark, tmp_path):
    recs = [_record("ASTRIDE", "820830", "06", "AL011982", [_series(500, 23, "ASTX")]), _record("BEAST", "200101", "18", "EP022020"),
            _record("LASTHEAD", "990505", "00", "WP031999")]
    (tmp_path / "all.dat").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(x for r in recs for x in r).encode())
    for size in (64, 999, 1 << 20):
        rows = diagnostics.ingest_case_diagnostics(spark, str(tmp_path), ["VMAX", "ASTX"], split_bytes=size).collect()
        at = {(r.NAME, r.TIME): r for r in rows}
        assert len(rows) == 3 * 23 and {n for n, _ in at} == {"ASTRIDE", "BEAST", "LASTHEAD"}
        assert at["ASTRIDE", -12].ASTX == "500" and at["BEAST", 0].ASTX is None and at["BEAST", 0].DATE_full.year == 2020
        assert at["LASTHEAD", 120].VMAX == "32"


def test_paths_folders_globs_and_packed_files(spark, tmp_path):
    text = "\n".join(_record("ALPHA", "820830", "06", "AL011982")) + "\n"
    for d in ("x", "x/deep", "x/_tmp", "y"):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
    for name in ("x/a.dat", "x/deep/b.dat", "x/_tmp/no.dat", "x/.no.dat", "y/c.txt", "y/empty.dat"):
        (tmp_path / name).write_text("" if "empty" in name else text)
    (tmp_path / "y/d.dat.gz").write_bytes(gzip.compress(text.encode() * 3))
    count = lambda p, **kw: case_records(spark, p, ["VMAX"], **kw).count()
    root = str(tmp_path)
    assert count(root) == 1 + 1 + 1 + 3 and count(f"file:{root}/x") == 2 and count(f"file://{root}/y") == 4
    assert count(f"{root}/*/a.dat") == 1 and count(f"{root}/[xy]") == 6 and count([f"{root}/x/a.dat", f"{root}/y/c.txt"]) == 2
    assert count(root, path_glob="*.dat") == 2 and count(f"{root}/y/empty.dat") == 0
    assert count([f"{root}/x/a.dat", f"{root}/x/a.dat"]) == 1  # a file named twice is read once
    assert [f[0].rsplit("/", 1)[1] for f in list_files(root)] == ["a.dat", "b.dat", "c.txt", "d.dat.gz", "empty.dat"]


def test_records_carry_where_they_stand(spark, tmp_path):
    data = body(1, 9)
    (tmp_path / "f.dat").write_bytes(data)
    rows = case_records(spark, str(tmp_path), ["RSST"], ages=["RSST"], split_bytes=300).orderBy("offset").collect()
    want = naive(data)
    assert [(r.offset, r.atcf_id, r.RSST, r.RSST_AGE) for r in rows] == \
        [(o, h[7].decode(), [v.decode() for v in m[b"RSST"][0]], m[b"RSST"][1].decode()) for o, h, m in want]


def test_packed_files_come_in_batches_and_share_a_task_by_their_text(tmp_path):
    """A packed file is read in one task: never all of its records at once."""
    text = "\n".join(x for i in range(2 * ROWS + 5) for x in _record("ALPHA", "820830", "06", f"AL{i:04d}1982")) + "\n"
    path = str(tmp_path / "a.dat.gz")
    (tmp_path / "a.dat.gz").write_bytes(gzip.compress(text.encode()))
    sizes = [b.num_rows for b in CaseRecordReader({"path": path}, ["VMAX"], []).read(Ranges([(path, path, 0, 1)]))]
    assert sizes == [ROWS, ROWS, 5]
    assert len(plan_ranges([("r", f"f{i}.gz", 6 << 20) for i in range(16)], 32 << 20)) == 16


def test_values_of_a_line_stay_one_string():
    lines = [b"A 820830 06 1 2 3 4 AL011982 HEAD", b" \t" + b"  ".join(b"%d" % i for i in range(23)) + b"\x0bVMAX \r",
             b" ".join(b"%d" % i for i in range(21)) + b" RSST 3", b"LAST"]
    (_, _, found), = raw_records(io.BytesIO(b"\n".join(lines)), 0, None, WANTED)
    assert found == {b"VMAX": (b" ".join(b"%d" % i for i in range(23)), None), b"RSST": (b"  " + b" ".join(b"%d" % i for i in range(21)), b"3")}


def test_bytes_that_are_no_text_are_replaced(spark, tmp_path):
    line = b" ".join([b"1"] * 22 + [b"\xff\xc3", b"VMAX"])
    (tmp_path / "a.dat").write_bytes(b"\n".join([b"A 820830 06 1 2 3 4 AL011982 HEAD", line, b"LAST\n"]))
    row, = case_records(spark, str(tmp_path), ["VMAX"]).collect()
    assert row.VMAX == ["1"] * 22 + [b"\xff\xc3".decode("utf-8", "replace")]


def test_rendered_records_collect_one_array_a_case(spark):
    from gale.plans import render
    from tests.conftest import SMALL
    plan = render.case_records(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
