"""Readers on handcrafted files in the reference layouts (BOM, CRLF, token
layouts, two-digit years, short deck lines)."""

import os
import tempfile


from gale.sources import decks, diagnostics


def _series(start, n, name, age=None):
    vals = " ".join(str(start + i) for i in range(n))
    return f"{vals} {name}" + (f" {age}" if age is not None else "")


def _record(name, yymmdd, hh, atcf, extra_lines=()):
    lines = [f"{name} {yymmdd} {hh} 45 20.0 60.0 1000 {atcf} HEAD",
             _series(10, 23, "VMAX"),
             _series(100, 23, "RSST", age=3),
             _series(200, 21, "IR00"),
             _series(300, 21, "PC00", age=0),
             *extra_lines, "LAST"]
    return lines


def test_case_records_layouts(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    a = _record("ALPHA", "820830", "06", "AL011982")
    b = _record("BETA", "200101", "18", "EP022020")
    c = _record("GAMMA", "990505", "00", "WP031999")
    cut = _record("DELTA", "990505", "06", "WP041999")[:-1]  # no LAST: dropped
    with open(f"{d}/lf.dat", "w", encoding="utf-8") as f:
        f.write("﻿" + "\n".join(a + b) + "\n")
    with open(f"{d}/crlf.dat", "w", encoding="utf-8", newline="") as f:
        f.write("\r\n".join(c + cut) + "\r\n")
    df = diagnostics.ingest_case_diagnostics(spark, d, ["VMAX", "RSST", "IR00", "PC00"],
                                             with_age=["RSST", "PC00"])
    rows = {(r.ATCFID, r.TIME): r for r in df.collect()}
    assert len(rows) == 3 * 23
    r = rows[("AL011982", -12)]
    assert r.DATE_full.year == 1982 and r.DATE_full.hour == 6 and r.NAME == "ALPHA"
    assert r.VMAX == "10" and r.RSST == "100" and r.RSST_AGE == "3"
    assert r.IR00 is None and r.PC00 is None and r.PC00_AGE == "0"
    assert rows[("AL011982", 0)].IR00 == "200"
    assert rows[("AL011982", 120)].VMAX == "32" and rows[("AL011982", 120)].IR00 == "220"
    assert rows[("EP022020", 0)].DATE_full.year == 2020
    assert rows[("WP031999", 6)].VMAX == "13"


def test_case_records_odd_files(spark, tmp_path):
    """Indented markers, lines of other lengths, repeated names, a truncated record before a whole one."""
    indent = [" " * 9 + x if x == "LAST" else x for x in _record("ALPHA", "820830", "06", "AL011982")]
    odd = _record("BETA", "200101", "18", "EP022020", extra_lines=["ONE", "1 2 SHRG", "3 4 SHRG", _series(50, 23, "VMAX"), "", "  "])
    cut = _record("GAMMA", "990505", "00", "WP031999")[:3]
    (tmp_path / "a.dat").write_text("\n".join(indent + odd) + "\n  LAST  \n" + "\n".join(cut + indent) + "\n")
    for wanted in (["VMAX", "SHRG"], []):
        rows = diagnostics.ingest_case_diagnostics(spark, str(tmp_path), wanted).collect()
        assert sorted({r.ATCFID for r in rows}) == ["AL011982", "EP022020"] and len(rows) == 3 * 23
    df = diagnostics.ingest_case_diagnostics(spark, str(tmp_path), ["VMAX", "SHRG"])
    beta = {r.TIME: r for r in df.where("ATCFID = 'EP022020'").collect()}
    assert beta[-12].VMAX == "50" and beta[-12].SHRG is None


def test_cycle_files_by_name(spark, tmp_path):
    for name, hh in (("20010118EP0220_lsdiag.dat", "18"), ("20010106EP0220_lsdiag.dat", "06"),
                     ("20010118EP0220_other.dat", "00"), ("20010118EP0320_lsdiag.dat", "18")):
        (tmp_path / name).write_text("\n".join(_record("BETA", "200101", hh, name[8:12] + "2020")) + "\n")
    got = diagnostics.scan_cycle_files(spark, str(tmp_path), "20010118EP", predictors=["VMAX"])
    assert {(r.ATCFID, r.DATE_full.hour) for r in got.collect()} == {("EP022020", 18), ("EP032020", 18)}


def test_deck_routing_and_short_tracks(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    with open(f"{d}/e.dat", "w") as f:
        f.write("AL, 05, 2020083006, RI, RIOC, 0, 150N, 600W, 35, 30, 0, ABC, 0, 24\n")
        f.write("AL, 05, 2020083006, IN, RIOD, 0, 150N, 600W, 12, XX, 0, 5\n")
        f.write("EP, 91, 2020083012, RW, LDA0, 0, 150N, 600W, 50, -30, 0, ABC, 0, 24,\n")
    ri = decks.ingest_prob_forecasts(spark, d, "RI").collect()
    assert len(ri) == 1 and ri[0]["Tech"] == "RIOC" and ri[0]["RIstopTAU"] == "24"
    rw = decks.ingest_prob_forecasts(spark, d, "RW").collect()
    assert rw[0]["RIstopTAU"] == "24" and rw[0]["Intensity Change"] == "-30"
    inn = decks.ingest_prob_forecasts(spark, d, "IN").collect()
    assert inn[0]["HalfRange"] == "5"
    with open(f"{d}/../b.dat", "w") as f:
        f.write("AL, 05, 2020083006, 03, BEST, 0, 150N, 600W, 45, 1000, TS, 34\n")
    t = decks.ingest_best_track(spark, f"{d}/../b.dat").collect()[0]
    assert t["RAD"] == "34" and t["SEAS4"] is None and t["ATCFID"] == "AL052020" and t["HOUR"] == 6
