"""Reader, ids, rules, repair, writing, diff and merge, on small texts made here."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupwise.functions import keys, values
from groupwise.operators import censor, emit, fix, merge_files, relational, rules, transfer, views
from groupwise.plans import composer
from groupwise.sources import delivery, lexer
from groupwise.sources.dictionary import Dictionary


def group(code, headings, units, types, *rows, end="\r\n"):
    lines = [["GROUP", code], ["HEADING", *headings], ["UNIT", *units], ["TYPE", *types], *[["DATA", *r] for r in rows]]
    return "".join(",".join('"' + c.replace('"', '""') + '"' for c in cells) + end for cells in lines)


DICT = group(
    "DICT", ["DICT_TYPE", "DICT_GRP", "DICT_HDNG", "DICT_STAT", "DICT_DTYP", "DICT_UNIT", "DICT_PGRP"], [""] * 7, ["X"] * 7,
    ["GROUP", "PROJ", "", "", "", "", ""], ["HEADING", "PROJ", "PROJ_ID", "KEY+REQUIRED", "ID", "", ""],
    ["GROUP", "TRAN", "", "", "", "", ""], ["HEADING", "TRAN", "TRAN_AGS", "OTHER", "X", "", ""], ["HEADING", "TRAN", "TRAN_DLIM", "OTHER", "X", "", ""], ["HEADING", "TRAN", "TRAN_RCON", "OTHER", "X", "", ""],
    ["GROUP", "LOCA", "", "", "", "", "PROJ"], ["HEADING", "LOCA", "LOCA_ID", "KEY+REQUIRED", "ID", "", ""], ["HEADING", "LOCA", "LOCA_TYPE", "OTHER", "PA", "", ""], ["HEADING", "LOCA", "LOCA_GL", "OTHER", "2DP", "m", ""],
    ["GROUP", "SAMP", "", "", "", "", "LOCA"], ["HEADING", "SAMP", "LOCA_ID", "KEY", "ID", "", ""], ["HEADING", "SAMP", "SAMP_TOP", "KEY", "2DP", "m", ""], ["HEADING", "SAMP", "SAMP_LINK", "OTHER", "RL", "", ""],
    ["GROUP", "UNIT", "", "", "", "", ""], ["HEADING", "UNIT", "UNIT_UNIT", "KEY", "X", "", ""], ["GROUP", "TYPE", "", "", "", "", ""], ["HEADING", "TYPE", "TYPE_TYPE", "KEY", "X", "", ""],
    ["GROUP", "ABBR", "", "", "", "", ""], ["HEADING", "ABBR", "ABBR_HDNG", "KEY", "X", "", ""], ["HEADING", "ABBR", "ABBR_CODE", "KEY", "X", "", ""], ["HEADING", "ABBR", "ABBR_DESC", "OTHER", "X", "", ""],
)
D = Dictionary.from_text(DICT, "4.1.1")
PROJ = group("PROJ", ["PROJ_ID"], [""], ["ID"], ["P1"])
TRAN = group("TRAN", ["TRAN_AGS", "TRAN_DLIM", "TRAN_RCON"], [""] * 3, ["X"] * 3, ["4.1.1", "|", "+"])
UNIT = group("UNIT", ["UNIT_UNIT"], [""], ["X"], ["m"])
TYPE = group("TYPE", ["TYPE_TYPE"], [""], ["X"], *[[t] for t in ("ID", "X", "PA", "2DP", "RL")])
ABBR = group("ABBR", ["ABBR_HDNG", "ABBR_CODE", "ABBR_DESC"], [""] * 3, ["X"] * 3, ["LOCA_TYPE", "CP", "Cable percussion"], ["LOCA_TYPE", "RC", "Rotary"])
LOCA = group("LOCA", ["LOCA_ID", "LOCA_TYPE", "LOCA_GL"], ["", "", "m"], ["ID", "PA", "2DP"], ["BH1", "CP+RC", "10.00"], ["BH2", "CP", "20.50"])
SAMP = group("SAMP", ["LOCA_ID", "SAMP_TOP", "SAMP_LINK"], ["", "m", ""], ["ID", "2DP", "RL"], ["BH1", "1.00", "LOCA|BH1"], ["BH2", "2.00", ""])
CLEAN = "\r\n".join([PROJ, TRAN, UNIT, TYPE, ABBR, LOCA, SAMP])


def test_golden_ids(spark):
    row = spark.range(1).select(
        keys.content_id("PROJ", [("PROJ_ID", F.lit(" P1\t"))]), keys.content_id("LOCA", [("LOCA_ID", F.lit("BH1"))]),
        keys.content_hash("LOCA", [("LOCA_ID", "", values.canonical_text(F.lit("BH01"), "ID")), ("LOCA_GL", "", values.canonical_text(F.lit("10.00"), "2DP"))]),
    ).first()
    assert tuple(row) == ("ac30a95d-e0ca-85f9-83c8-37a64af2762b", "a7025a6f-d9b8-83b6-8fad-81c0c744edbc", "60eed2bb-66b4-8ffd-b920-1adc741badc7")


@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=8), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_fields_round_trip(cells):
    assert lexer.fields(emit.line(*cells)[:-2]) == cells
    assert lexer.strictly_quoted(emit.line(*cells)[:-2])


@pytest.mark.parametrize(("text", "want"), [('"a","b', ["a", "b"]), ("a,b", ["a", "b"]), ('"a"junk,"b"', ["a", "b"]), ('"a""b"', ['a"b']), ('"a",', ["a"]), ("", [])])
def test_tolerant_fields(text, want):
    assert lexer.fields(text) == want


def test_records_keep_quoted_breaks():
    got = [(r.line, r.text, r.terminator) for r in lexer.records('"a\nb"\r\n"c"\r"d"')]
    assert got == [(1, '"a\nb"', "\r\n"), (3, '"c"', "\r"), (4, '"d"', "")]


def test_byte_index():
    raw = "﻿".encode() + (PROJ + LOCA).encode()
    (a, s1, e1), (b, s2, e2) = lexer.byte_index(raw)
    assert (a, b, s1, e1, e2) == ("PROJ", "LOCA", 3, s2, len(raw))
    assert raw[s2:e2].decode() == LOCA


def test_read(spark):
    d = delivery.read_text(spark, CLEAN, dictionary=D)
    assert d.groups == ["PROJ", "TRAN", "UNIT", "TYPE", "ABBR", "LOCA", "SAMP"]
    assert [tuple(r) for r in d["LOCA"].collect()] == [("BH1", "CP+RC", 10.0), ("BH2", "CP", 20.5)]
    joined = d.sql("select l.LOCA_ID from SAMP s join LOCA l on s._parent_id = l._id where s.SAMP_TOP > 1").collect()
    assert [r[0] for r in joined] == ["BH2"]
    assert {r["group"]: r["n_rows"] for r in d.group_catalog().collect()}["SAMP"] == 2
    assert [r["sql_type"] for r in d.heading_catalog().where("`group` = 'LOCA'").orderBy("ordinal").collect()] == ["VARCHAR", "VARCHAR", "DOUBLE"]
    assert [r["HEADING"] for r in d.strings("LOCA").orderBy("_at").collect()] == ["UNIT", "TYPE", "DATA", "DATA"]


def test_files_of_different_shape(spark, tmp_path):
    """Cells are found by heading in every file, and in every section of a file."""
    files = {
        "a": group("LOCA", ["LOCA_ID", "LOCA_GL"], ["", "m"], ["ID", "2DP"], ["BH1", "1.00"]),
        "b": group("LOCA", ["LOCA_GL", "LOCA_ID", "LOCA_REM"], ["", "", ""], ["3DP", "ID", "X"], ["2.000", "BH2", "r"]) + group("LOCA", ["LOCA_ID"], [""], ["ID"], ["BH3"]) + '"GROUP","LOCA"\r\n"DATA","BH4"\r\n',
        "c": group("LOCA", ["LOCA_REM", "LOCA_ID"], ["", ""], ["X", "ID"], ["only", "BH5"]),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.ags").write_bytes(text.encode())
    d = delivery.read(spark, str(tmp_path), dictionary=D)
    assert d.shapes["LOCA"] == delivery.Shape(["LOCA_ID", "LOCA_GL", "LOCA_REM"], ["", "m", ""], ["ID", "3DP", "X"])
    got = sorted(tuple(r) for r in d["LOCA"].collect())
    assert got == [("BH1", 1.0, None), ("BH2", 2.0, "r"), ("BH3", None, None), ("BH4", None, None), ("BH5", None, "only")]
    d.close()
    (tmp_path / "d.ags").write_bytes(group("LOCA", ["LOCA_ID", "LOCA_GL"], ["", "ft"], ["ID", "2DP"], ["BH6", "1.00"]).encode())
    with pytest.raises(lexer.DeliveryError) as e:
        delivery.read(spark, str(tmp_path))
    assert e.value.kind == "UnitClash"


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "x.ags").write_bytes(b"hello")
    for raw, kind in ((b"hello", "NotGrouped"), (b'"**PROJ"', "UnsupportedEdition"), (b'"GROUP","A\xff"', "NotUtf8")):
        (tmp_path / "x.ags").write_bytes(raw)
        with pytest.raises(lexer.DeliveryError) as e:
            delivery.read(spark, str(tmp_path))
        assert e.value.kind == kind


def test_own_dictionary_gives_ids(spark):
    own = group("DICT", ["DICT_TYPE", "DICT_GRP", "DICT_HDNG", "DICT_STAT", "DICT_PGRP"], [""] * 5, ["X"] * 5, ["GROUP", "XTRA", "", "", "LOCA"], ["HEADING", "XTRA", "LOCA_ID", "KEY", ""], ["HEADING", "XTRA", "XTRA_NO", "KEY", ""], ["HEADING", "LOCA", "LOCA_NEW", "KEY", ""])
    xtra = group("XTRA", ["LOCA_ID", "XTRA_NO"], ["", ""], ["ID", "ID"], ["BH1", "1"])
    d = delivery.read_text(spark, CLEAN + own + xtra, dictionary=D)
    assert d.dictionary.key_chain("XTRA") == ["LOCA_ID", "XTRA_NO"] and d.dictionary.key_chain("LOCA") == D.key_chain("LOCA")
    joined = d.table("XTRA", keys_too=True).select("_id", "_parent_id").join(d.table("LOCA", keys_too=True).select(F.col("_id").alias("up"), "LOCA_ID"), F.col("_parent_id") == F.col("up"))
    assert [r["LOCA_ID"] for r in joined.collect()] == ["BH1"] and joined.where("_id is null").count() == 0
    assert delivery.read_text(spark, CLEAN + own + xtra, dictionary=D, own_dict=False).table("XTRA", keys_too=True).columns == ["LOCA_ID", "XTRA_NO"]


def test_selections_add_up(spark):
    d = delivery.read_text(spark, CLEAN, dictionary=D)
    one = views.Selection(d).at("LOCA", ["BH1", "BH2"]).at("LOCA", ["BH2"])
    assert [r["LOCA_ID"] for r in one["LOCA"].collect()] == ["BH2"] and [r["LOCA_ID"] for r in one["SAMP"].collect()] == ["BH2"] and one["PROJ"].count() == 1
    ids = [r["_id"] for r in d.table("LOCA", keys_too=True).where("LOCA_ID = 'BH1'").collect()]
    by_id = views.Selection(d).at("LOCA", ids, by="_id")
    assert [t.count() for t in (by_id["LOCA"], by_id["SAMP"], by_id["UNIT"])] == [1, 1, 1]
    assert views.Selection(d).at("LOCA", [])["SAMP"].count() == 0
    with pytest.warns(UserWarning):
        assert views.Selection(d).at("LOCA", [None, "BH1"])["LOCA"].count() == 1
    with pytest.raises(ValueError):
        views.Selection(d).at("GEOL", ["x"])


def test_rows_attached_to_parents(spark):
    lost = group("SAMP", ["LOCA_ID", "SAMP_TOP"], ["", "m"], ["ID", "2DP"], ["BH9", "1.00"], ["BH1", "1.00"], ["BH1", "1.00"])
    odd = group("ODDS", ["LOCA_ID", "ODDS_X"], ["", ""], ["ID", "X"], ["BH1", "a"], ["BH9", "b"])
    d = delivery.read_text(spark, "\r\n".join([PROJ, LOCA, lost, odd]), dictionary=D)
    graph = views.attached(d)
    assert [(r["LOCA_ID"], r["SAMP_TOP"]) for r in graph["SAMP"].collect()] == [("BH1", 1.0)]
    assert [r["ODDS_X"] for r in graph["ODDS"].collect()] == ["a"]
    root = graph["PROJ"].first()["_id"]
    tree = views.record(graph, d, "PROJ", root)
    first = next(x for x in tree["LOCA"] if x["LOCA_ID"] == "BH1")
    assert len(tree["LOCA"]) == 2 and first["SAMP"] == [{"LOCA_ID": "BH1", "SAMP_TOP": 1.0}] and first["ODDS"] == [{"LOCA_ID": "BH1", "ODDS_X": "a"}]


def test_edits_and_text_tables(spark):
    d = delivery.read_text(spark, CLEAN, dictionary=D)
    found = {b.group: b for b in views.blocks(d)}
    loca = views.push_row(views.set_cell(found["LOCA"], "LOCA_GL", "9.99", F.col("LOCA_ID") == "BH1"), {"LOCA_ID": "BH3"})
    loca = views.push_row(loca, {"LOCA_ID": "BH4", "LOCA_GL": "1.00"})
    text = emit.to_text([found["PROJ"], loca])
    assert text == PROJ + "\r\n" + group("LOCA", ["LOCA_ID", "LOCA_TYPE", "LOCA_GL"], ["", "", "m"], ["ID", "PA", "2DP"], ["BH1", "CP+RC", "9.99"], ["BH2", "CP", "20.50"], ["BH3", "", ""], ["BH4", "", "1.00"])
    assert [b.group for b in views.remove_group(views.blocks(d), "ABBR")] == [g for g in d.groups if g != "ABBR"]
    with pytest.raises(KeyError):
        views.push_row(loca, {"NOPE": "x"})
    table = views.text_tables(d)["LOCA"]
    numbers = views.numeric(table)
    assert [tuple(r) for r in numbers.collect()] == [("BH1", "CP+RC", 10.0), ("BH2", "CP", 20.5)]
    assert [r["LOCA_GL"] for r in views.texts(numbers, {"LOCA_GL": "2DP"}).collect()] == ["10.00", "20.50"]
    assert views.declared_edition(d) == "4.1.1"
    back = views.block_of_arrow(spark, "LOCA", views.arrow(d, "LOCA"), D)
    assert emit.to_text([back]) == LOCA
    rows = spark.createDataFrame([(2, ["DATA", 'a"b', None]), (1, ["GROUP", "X"])], "n int, cells array<string>")
    assert [r[0] for r in views.matrix_lines(rows, "cells", ["n"]).collect()] == ['"GROUP","X"\r\n', '"DATA","a""b",""\r\n']


def test_orders_depths_editions_and_series(spark):
    found = ["SAMP", "ABBR", "ZZZZ", "LOCA", "TRAN", "PROJ"]
    with pytest.warns(UserWarning):
        assert views.group_order(found, D) == ["PROJ", "ABBR", "TRAN", "LOCA", "SAMP", "ZZZZ"]
    with pytest.warns(UserWarning):
        assert views.group_order(found, D, "hierarchical") == ["PROJ", "TRAN", "ABBR", "LOCA", "SAMP", "ZZZZ"]
    assert views.group_order(found, D, "alphabetical") == sorted(found)
    assert views.probe_depth("SAMP", ["SAMP_TOP", "SPEC_DPTH"], D) == ("SPEC_DPTH", "specimen") and views.probe_depth("LOCA", ["LOCA_ID"], D) is None
    assert rules.guarded_edition("4.0.3", {"LOCA": ["LOCA_ID", "LOCA_NATD"]}) == ("4.0.4", "LOCA_NATD")
    assert rules.guarded_edition("4.0.3", {"LOCA": ["LOCA_NATD"]}, forced=True) == ("4.0.3", None) and rules.guarded_edition("4.1", {}) == ("4.1", None)
    rows = spark.createDataFrame([("a", 1, 2.0), ("Other", 2, 3.0), ("c", 3, 4.0), (None, 4, 5.0)], "k string, x int, y double")
    got = sorted(tuple(r) for r in views.chart_series(rows, "x", "y", "k", ["a", "Other", "c"], 2).collect())
    assert got == [(-1, "Other *", 3, 4.0), (-1, "Other *", 4, 5.0), (0, "a", 1, 2.0), (1, "Other", 2, 3.0)]


def test_changes_as_json(spark):
    a, b = (delivery.read_text(spark, x, dictionary=D) for x in (CLEAN, CLEAN.replace("20.50", "21.50").replace(ABBR, "")))
    out = {(r["group"], r["kind"]): r["value"] for r in views.diff_json(*merge_files.diff(a, b, D), spark).collect()}
    assert ("ABBR", "group_removed") in out and json.loads(out["LOCA", "changed"])["cells"][0]["heading"] == "LOCA_GL"


def test_codes_near_others():
    known = ["CLAY", "clay", "C-LAY", "SAND", "SILT", "GRAVEL", "U", "D"]
    assert values.close_matches("CLAY", known) == ["clay", "C-LAY"]
    assert values.close_matches("SANT", known) == ["SAND"] and values.close_matches("GRVELL", known) == [] and values.close_matches("GRAVELLL", known) == ["GRAVEL"] and values.close_matches("X", known) == []


def test_types_of_cells(spark):
    cells = ["5.", "5", "-5", ".", "1:02:03", "1234:02:03.", "1:2:3", "10:30", "1:30"]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    dms = [r[0] for r in df.where(values.is_dms(F.col("v"))).collect()]
    assert [r[0] for r in df.where(values.is_ndp(F.col("v"), 0)).collect()] == ["5.", "5", "-5"] and dms == ["1:02:03", "1234:02:03."]
    assert [r[0] for r in df.where(values.is_elapsed(F.col("v"), F.lit("hh:mm"))).collect()] == ["10:30"]
    assert [values.format_nsf(0.002, 3), values.format_nsf(1234, 3), values.format_nsf(1255, 3), values.format_nsf(-0.09996, 3)] == ["0.00200", "1230", "1260", "-0.100"]
    assert [values.format_nsci(-0.000031, 1), values.format_nsci(9.996, 2), values.format_nsci(0, 1)] == ["-3.1e-5", "1.00e1", "0.0e0"]


def test_structure_errors(spark):
    twice = group("LOCA", ["LOCA_ID", "LOCA_ID"], ["", ""], ["ID", "ID"], ["a", "b"])
    with pytest.raises(lexer.DeliveryError):
        delivery.read_text(spark, twice)
    assert delivery.read_text(spark, twice, on_duplicate="recover")["LOCA"].columns == ["LOCA_ID", "LOCA_ID__2"]
    long = group("LOCA", ["LOCA_ID"], [""], ["ID"], ["a", "b"])
    assert delivery.read_text(spark, long, on_excess="truncate")["LOCA"].collect() == [("a",)]
    with pytest.raises(Exception, match="too many fields"):
        delivery.read_text(spark, long)["LOCA"].collect()
    for bad, kind in (("hello", "NotGrouped"), ('"**PROJ"', "UnsupportedEdition")):
        with pytest.raises(lexer.DeliveryError) as e:
            delivery.read_text(spark, bad)
        assert e.value.kind == kind


@pytest.mark.parametrize(
    ("code", "unit", "raw", "want"),
    [("0DP", "", "5.9", "5"), ("0DP", "", "1d", None), ("2DP", "", "NaN", None), ("2DP", "", " .5 ", "0.5"), ("YN", "", "yes", "true"), ("DT", "", "25/12/2020", "2020-12-25 00:00:00"), ("DT", "yyyy", "2020", "2020-01-01 00:00:00"), ("DT", "yyyy", "2020-01", None), ("DT", "hh:mm", "9:05", "09:05:00"), ("X", "", "  ", None), ("ZZ", "", "q", "q")],
)
def test_parse(spark, code, unit, raw, want):
    got = spark.range(1).select(values.parse(F.lit(raw), code, unit).cast("string")).first()[0]
    assert got == want


def test_formats():
    assert [values.format_ndp(0.125, 2), values.format_ndp(1.005, 2)] == ["0.12", "1.00"]
    assert [values.format_nsf(9.96, 2), values.format_nsf(123456, 3), values.format_nsf(0, 3)] == ["10", "123000", "0.00"]
    assert [values.format_nsci(1234.5, 2), values.format_nsci(50, 0)] == ["1.23e3", "5.e1"]
    assert values.edit_distance("LOAC", "LOCA") == 1


CASES = [
    ('"BH2","CP","20.50"', '"BH1","CP","20.50"', "10a"), ('"BH2","CP","20.50"', '"","CP","20.50"', "10b"), ('"BH2","2.00"', '"BH9","2.00"', "10c"), ('"20.50"', '"20.5"', "8"), ('"BH2","CP"', '"BH2","XX"', "16"),
    ("LOCA|BH1", "LOCA|BH7", "11c"), ('"DATA","m"', '"DATA","ft"', "15"), ('"DATA","RL"\r\n', "", "17"), ('"PROJ_ID"', '"PROJ_QQ"', "9"), ('"GROUP","SAMP"', '"GROUP","samp"', "19"), ('"DATA","P1"\r\n', "", "2"),
    ('"UNIT","","m",""\r\n', "", "2b"), ('"BH2","2.00",""', '"BH2","2.00"', "4"), ('"BH2","2.00",""', 'BH2,"2.00",""', "5"), ('"LOCA_TYPE","LOCA_GL"\r\n"UNIT","","","m"', '"LOCA_GL","LOCA_TYPE"\r\n"UNIT","","","m"', "7"),
    ('"BH2","CP"', '"BH2","€"', "1"), ('"DATA","P1"', '"DATA","P1"\r\n"DATA","P2"', "13"), ('"4.1.1","|"', '"4.1.1",""', "11a"), ('"DATA","P1"\r\n', '"DATA","P1"\n', "2a"), ('"DATA","P1"', '"DATUM","P1"', "3"),
]


def test_rules(spark):
    """One plan over a corpus of files, each with one defect, and a clean one."""
    records = [r for i, (old, new, _) in enumerate(CASES) for r in delivery._tuples(str(i), CLEAN.replace(old, new, 1).encode(), "utf-8", "strict")]
    records += delivery._tuples("clean", CLEAN.encode(), "utf-8", "strict")
    assert all(old in CLEAN for old, _, _ in CASES)
    found = rules.validate(spark.createDataFrame(records, delivery.ROWS).coalesce(1).cache(), D).select("file", "rule", "severity").distinct().collect()
    assert not [r for r in found if r["file"] == "clean" and r["severity"] == "error"]
    missed = [c for i, c in enumerate(CASES) if (str(i), c[2]) not in {(r["file"], r["rule"]) for r in found}]
    assert not missed


def test_hints_of_near_codes(spark):
    texts = {"near": CLEAN.replace('"BH2","CP"', '"BH2","cp"'), "far": CLEAN.replace('"BH2","CP"', '"BH2","QQQQQQ"'), "clean": CLEAN}
    records = [r for name, text in texts.items() for r in delivery._tuples(name, text.encode(), "utf-8", "strict")]
    assert '"BH2","CP"' in CLEAN
    found = rules.validate(spark.createDataFrame(records, delivery.ROWS).coalesce(1).cache(), D).where("rule = '16' and desc like '%did you mean%'").collect()
    assert [(r["file"], r["severity"]) for r in found] == [("near", "fyi")] and "did you mean CP (in ABBR)" in found[0]["desc"]
    hint = lambda part, codes: spark.range(1).select(rules._hints(D)(F.lit("X_Y"), F.lit(part), F.lit(codes)).alias("h")).first()["h"]
    assert "'AB '" in hint("AB", ["AB ", "CD"]) and hint("AB", ["XYZ"]) is None


def test_fix_converges(spark):
    broken = "﻿" + CLEAN.replace("\r\n", "\n").replace('"20.50"', '"20.5"').replace('"BH2","2.00",""', '"BH2","2.00"')
    text, done = fix.fix_until_stable(broken)
    assert text == CLEAN
    assert set(done) == {"bom", "line_ends", "numbers", "short_rows"}
    assert fix.fixed_text(text)[1] == {}
    assert fix.to_date("18.08.20") == ("2020-08-18", False) and fix.to_date("2020.08.18") is None
    assert fix.to_date("18/08/2020 09:30", "yyyy-mm-ddThh:mm") == ("2020-08-18T09:30", False) and fix.to_date("18/08/2020 09:30") is None and fix.to_date("18/08/2020", "yyyy-mm-ddThh:mm") is None
    assert fix.to_date("31/01/2020") == ("2020-01-31", False) and fix.to_date("02/01/2020")[1]
    assert fix.ascii_fold("25 °C – é") == "25 degC - e"


def test_emit_round_trip(spark, tmp_path):
    d = delivery.read_text(spark, CLEAN, dictionary=D)
    blocks = [emit.Block(g, d.raw(g), s.headings, s.units, s.types, ["data_row"]) for g, s in d.shapes.items()]
    assert emit.to_text(blocks) == CLEAN
    emit.write_xlsx(blocks, str(tmp_path / "a.xlsx"))
    assert emit.to_text(emit.read_xlsx(spark, str(tmp_path / "a.xlsx"))) == CLEAN
    built, found = emit.build([emit.typed_block("LOCA", d["LOCA"], D, order=["LOCA_ID"]), emit.typed_block("PROJ", d["PROJ"], D)], D, "report", {"TRAN_AGS": "4.1.1"})
    assert '"DATA","BH2","CP","20.50"' in built and '"DATA","LOCA_TYPE","RC",""' in built
    assert "8" not in {r["rule"] for r in found.collect()}


def test_diff_and_merge(spark):
    a = delivery.read_text(spark, PROJ + group("LOCA", ["LOCA_ID", "LOCA_GL"], ["", "m"], ["ID", "2DP"], ["BH1", "1.00"], ["BH2", "2.00"], ["BH3", "3.00"]), dictionary=D)
    b = delivery.read_text(spark, PROJ + group("LOCA", ["LOCA_ID", "LOCA_GL", "LOCA_TYPE"], ["", "m", ""], ["ID", "2DP", "PA"], ["BH2", "2.50", "CP"], ["BH1", "1.000", ""], ["BH4", "4.00", ""]), dictionary=D)
    added, removed, both = merge_files.diff(a, b, D)
    assert (added, removed) == ([], [])
    assert sorted((r["kind"], r["key"][0]) for r in both["LOCA"].collect()) == [("added", "BH4"), ("changed", "BH2"), ("removed", "BH3")]
    assert merge_files.diff(a, a, D)[2]["LOCA"].count() == 0
    text = emit.to_text(merge_files.merge([a, b], D))
    rows = [r.values for r in lexer.rows(text) if r.tag == "DATA" and r.group == "LOCA"]
    assert rows == [["BH1", "1.000", ""], ["BH2", "2.50", "CP"], ["BH3", "3.00", ""], ["BH4", "4.00", ""]]
    with pytest.raises(lexer.DeliveryError):
        merge_files.merged_type(["2DP", "X"], "error")
    assert merge_files.merged_type(["2DP", "3DP"], "promote") == "3DP"


def test_merge_keeps_every_transmission(spark):
    keyed = Dictionary.from_text(group("DICT", ["DICT_TYPE", "DICT_GRP", "DICT_HDNG", "DICT_STAT"], [""] * 4, ["X"] * 4, ["GROUP", "TRAN", "", ""], ["HEADING", "TRAN", "TRAN_ISNO", "KEY"])).layered(D)
    tran = lambda no, day, *more: group("TRAN", ["TRAN_ISNO", "TRAN_DATE", *["TRAN_REM"] * len(more)], [""] * (2 + len(more)), ["X", "DT", *["X"] * len(more)], [no, day, *more])
    loca = lambda t: group("LOCA", ["LOCA_ID", "LOCA_GL"], ["", "m"], ["ID", t], ["BH1", "1.00"])
    files = [delivery.read_text(spark, PROJ + t + loca(d), dictionary=keyed) for t, d in ((tran("1", "2024-05-02", "first"), "2DP"), (tran("2", "2024-05-01"), "3DP"), (tran("2", "2024-05-03"), "2DP"))]
    warnings = []
    text = emit.to_text(merge_files.merge(files, keyed, "promote", warnings=warnings))
    rows = [r.values for r in lexer.rows(text) if r.tag == "DATA" and r.group == "TRAN"]
    assert rows == [["1", "2024-05-02", "first"], ["2", "2024-05-03", ""]]
    assert [(w["kind"], w["group"], w["heading"]) for w in warnings] == [("recency_contradiction", "TRAN", "TRAN_DATE"), ("tran_not_stamped", "TRAN", None), ("type_promoted", "LOCA", "LOCA_GL")]
    widened = []
    merge_files.merge(files, keyed, "widen", warnings=widened)
    assert widened[-1]["kind"] == "type_widened"
    with pytest.raises(lexer.DeliveryError):
        merge_files.merge(files, keyed, "widen", missing_tran="error")


def test_censor(spark):
    df = spark.createDataFrame([(1, "Zed", "stiff (brown) clay [LONDON CLAY]"), (2, "Amy", "x [ ] [y"), (3, "Zed", "")], "n int, who string, note string")
    got = censor.censor(df, {"who": "pseudonym", "note": "brackets"}, "n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "ID0001", "stiff (brown) clay [REDACTED]"), (2, "ID0002", "x [ ] [y"), (3, "ID0001", "")]
    word = df.select(censor.redact_keywords(F.col("note"), ["CLAY"], "$1\\").alias("v")).first()[0]
    assert word == "stiff (brown) $1\\ [LONDON $1\\]"


def test_transfer():
    raw = CLEAN.encode()
    assert transfer.unpack(transfer.pack(raw)) == raw
    cert = json.loads(json.dumps(transfer.certificate(raw, {"error": 0}, "4.1.1")))
    assert transfer.revalidate_reasons(cert, raw, "4.1.1") == []
    assert "content" in transfer.revalidate_reasons(cert, raw + b"x", "4.1.1")


def test_coordinates_and_geojson(spark):
    lon, lat = transfer.to_wgs84(F.col("e"), F.col("n"))
    df = spark.createDataFrame([(530000.0, 180000.0, "a")], "e double, n double, id string").select(lon.alias("lon"), lat.alias("lat"), "id")
    r = df.first()
    assert abs(r["lon"] + 0.1284) < 1e-3 and abs(r["lat"] - 51.5037) < 1e-3
    assert json.loads(emit.geojson(df, "lon", "lat", ["id"]))["features"][0]["properties"] == {"id": "a"}


def test_band_join_cells_agree(spark):
    p = spark.createDataFrame([("a", x / 4) for x in range(40)], "k string, d double")
    b = spark.createDataFrame([("a", 1.0, 3.5, 1), ("a", 3.5, 3.5, 2), ("a", 3.0, 9.0, 3)], "bk string, top double, base double, id int")
    plain = relational.band_join(p, b, [("k", "bk")], "d", "top", "base").select("d", "id")
    celled = relational.band_join(p, b, [("k", "bk")], "d", "top", "base", width=2.0).select("d", "id")
    assert sorted(plain.collect()) == sorted(celled.collect()) and plain.count() == 10 + 24


def test_composer(spark):
    spec = composer.Select("t", ["a"], [composer.Condition("a", "LIKE", "5%"), composer.Condition("b", ">", "")], order_by="a", limit=3)
    spark.createDataFrame([("15%",), ("5",), ("5%x",)], "a string").createOrReplaceTempView("t")
    assert composer.frame(spec, {"t": spark.table("t")}).collect() == spark.sql(composer.sql(spec)).collect() == [("15%",), ("5%x",)]
    assert composer.result_names([("t", ["a", "b"]), ("u", ["a"]), ("u", ["a"])])["u", "a"] == "u_a_2"


def test_dictionary():
    assert D.key_chain("SAMP") == ["LOCA_ID", "SAMP_TOP"] and list(D.ancestors("SAMP")) == ["LOCA", "PROJ"]
    assert ("SAMP", "descendant", ["LOCA_ID"]) in D.related("LOCA")
    over = D.layered(Dictionary.from_text(group("DICT", ["DICT_TYPE", "DICT_GRP", "DICT_HDNG", "DICT_STAT"], [""] * 4, ["X"] * 4, ["HEADING", "LOCA", "LOCA_NEW", "KEY"], ["GROUP", "XTRA", "", ""])))
    assert over.key_chain("LOCA") == ["LOCA_ID"] and "XTRA" in over.groups


def test_stream(spark, tmp_path):
    from groupwise.streaming import deliveries

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ags").write_text(CLEAN, newline="")
    records = deliveries.stream(spark, str(tmp_path / "in"))
    typed = lambda df: df.select(F.get("values", F.lit(0)).alias("id"), "arrived")
    q = deliveries.upsert(records, "LOCA", lambda df: typed(df.where("tag = 'DATA'")), str(tmp_path / "out"), ["id"], "arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()) == ["BH1", "BH2"]
