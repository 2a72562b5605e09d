"""Operators on deliveries over files made of the star schema, each with its SQL.

Customers become files of FILE keys each (so a file stays small however many there are):
a PROJ, TRAN, UNIT, TYPE and ABBR group, the customers as LOCA, and a SAMP row of each.
Defects are planted by key, so SQL over ``customer`` tells what every operator must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import censor, emit, fix, merge_files, rules, views
from ..sources import delivery
from ..sources.dictionary import Dictionary
from .driver import query, t

FILE = 400
_FILE_SQL = f"'f' || (c_custkey // {FILE})"


def _group(code: str, headings: list[str], units: list[str], types: list[str], *rows: list[str]) -> str:
    return "".join(emit.line(*cells) for cells in (["GROUP", code], ["HEADING", *headings], ["UNIT", *units], ["TYPE", *types], *(["DATA", *r] for r in rows)))


def dictionary() -> Dictionary:
    """The dictionary of these files."""
    heads = {
        ("PROJ", ""): [("PROJ_ID", "KEY+REQUIRED", "ID", "")],
        ("TRAN", ""): [("TRAN_AGS", "OTHER", "X", ""), ("TRAN_DLIM", "OTHER", "X", ""), ("TRAN_RCON", "OTHER", "X", "")],
        ("UNIT", ""): [("UNIT_UNIT", "KEY", "X", "")],
        ("TYPE", ""): [("TYPE_TYPE", "KEY", "X", "")],
        ("ABBR", ""): [("ABBR_HDNG", "KEY", "X", ""), ("ABBR_CODE", "KEY", "X", ""), ("ABBR_DESC", "OTHER", "X", "")],
        ("LOCA", "PROJ"): [("LOCA_ID", "KEY+REQUIRED", "ID", ""), ("LOCA_TYPE", "OTHER", "PA", ""), ("LOCA_GL", "OTHER", "2DP", "m"), ("LOCA_REM", "REQUIRED", "X", "")],
        ("SAMP", "LOCA"): [("LOCA_ID", "KEY", "ID", ""), ("SAMP_TOP", "KEY", "2DP", "m")],
    }
    rows = []
    for (g, parent), hs in heads.items():
        rows += [["GROUP", g, "", "", "", "", parent], *(["HEADING", g, h, s, k, u, ""] for h, s, k, u in hs)]
    names = ["DICT_TYPE", "DICT_GRP", "DICT_HDNG", "DICT_STAT", "DICT_DTYP", "DICT_UNIT", "DICT_PGRP"]
    return Dictionary.from_text(_group("DICT", names, [""] * 7, ["X"] * 7, *rows), "4.1.1")


_KINDS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_TOP = "\r\n".join([
    _group("PROJ", ["PROJ_ID"], [""], ["ID"], ["P1"]),
    _group("TRAN", ["TRAN_AGS", "TRAN_DLIM", "TRAN_RCON"], [""] * 3, ["X"] * 3, ["4.1.1", "|", "+"]),
    _group("UNIT", ["UNIT_UNIT"], [""], ["X"], ["m"]),
    _group("TYPE", ["TYPE_TYPE"], [""], ["X"], *([k] for k in ("ID", "X", "PA", "2DP"))),
    _group("ABBR", ["ABBR_HDNG", "ABBR_CODE", "ABBR_DESC"], [""] * 3, ["X"] * 3, *(["LOCA_TYPE", k, k.lower()] for k in _KINDS[:-1])),
])
_LOCA = ["LOCA_ID", "LOCA_TYPE", "LOCA_GL", "LOCA_REM"]


def _line(*cells: Column) -> Column:
    return F.concat(F.lit('"DATA","'), F.concat_ws('","', *cells), F.lit('"\r\n'))


def contents(customer: DataFrame, gl: str = "format_string('%.2f', c_acctbal)", rem: str = "c_name", key: str = "string(c_custkey)", parent: str = "string(c_custkey)", times: str = "1", turned: bool = False) -> DataFrame:
    """(path, content) of the files; cells are SQL expressions, ``turned`` reverses the headings of every other file."""
    file = F.floor(F.col("c_custkey") / FILE).cast("long")
    cells = [F.expr(key), F.col("c_mktsegment"), F.expr(gl), F.expr(rem)]
    odd = (F.col("file") % 2 == 1) & F.lit(turned)
    lines = customer.withColumn("file", file).select(
        "file", "c_custkey",
        F.array_repeat(F.when(odd, _line(*reversed(cells))).otherwise(_line(*cells)), F.expr(times).cast("int")).alias("loca"),
        _line(F.expr(parent), F.lit("1.00")).alias("samp"),
    )
    rows = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "loca", "samp"))).alias("rows"))
    heads = {o: _group("LOCA", _LOCA[::o], ["", "", "m", ""][::o], ["ID", "PA", "2DP", "X"][::o]) for o in (1, -1)}
    loca = F.array_join(F.flatten(F.transform("rows", lambda r: r["loca"])), "")
    samp = F.array_join(F.transform("rows", lambda r: r["samp"]), "")
    text = F.concat(F.lit(_TOP + "\r\n"), F.when(odd, heads[-1]).otherwise(heads[1]), loca, F.lit("\r\n" + _group("SAMP", ["LOCA_ID", "SAMP_TOP"], ["", "m"], ["ID", "2DP"])), samp)
    return rows.select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("path"), text.cast("binary").alias("content"))


def _delivery(spark: SparkSession, sf_dir: str, **how) -> delivery.Delivery:
    return delivery.Delivery(delivery.scan_contents(contents(t(spark, sf_dir, "customer"), **how), check=True), dictionary=dictionary())


@query(f"SELECT {_FILE_SQL} AS file, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS kind, round(c_acctbal, 2) AS level, c_name AS remark FROM customer")
def delivery_typed(spark, sf_dir):
    """Files whose headings stand in different order, read as one typed table."""
    d = _delivery(spark, sf_dir, turned=True)
    return d.table("LOCA", source=True).select("file", F.col("LOCA_ID").alias("id"), F.col("LOCA_TYPE").alias("kind"), F.col("LOCA_GL").alias("level"), F.col("LOCA_REM").alias("remark"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(1 AS DOUBLE) AS top, round(c_acctbal, 2) AS level FROM customer")
def delivery_parent_join(spark, sf_dir):
    """Rows meet their parents by content id."""
    d = _delivery(spark, sf_dir, turned=True)
    loca = d.table("LOCA", keys_too=True).select(F.col("_id").alias("up"), F.col("LOCA_GL").alias("level"))
    samp = d.table("SAMP", keys_too=True)
    return samp.join(loca, samp["_parent_id"] == loca["up"]).select(F.col("LOCA_ID").alias("id"), F.col("SAMP_TOP").alias("top"), "level")


@query(f"""
    WITH f AS (SELECT count(DISTINCT c_custkey // {FILE}) AS n FROM customer), c AS (SELECT count(*) AS n FROM customer)
    SELECT "group", CAST(n AS BIGINT) AS n_rows, n_headings FROM (
        SELECT 'PROJ' AS "group", f.n, 1 AS n_headings FROM f UNION ALL SELECT 'TRAN', f.n, 3 FROM f UNION ALL SELECT 'UNIT', f.n, 1 FROM f UNION ALL SELECT 'TYPE', 4 * f.n, 1 FROM f
        UNION ALL SELECT 'ABBR', {len(_KINDS) - 1} * f.n, 3 FROM f UNION ALL SELECT 'LOCA', c.n, 4 FROM c UNION ALL SELECT 'SAMP', c.n, 2 FROM c)""")
def delivery_catalog(spark, sf_dir):
    return _delivery(spark, sf_dir, turned=True).group_catalog()


@query(f"""
    WITH c AS (SELECT *, {_FILE_SQL} AS file, CASE WHEN c_custkey % 17 = 0 THEN 2 ELSE 1 END AS times FROM customer),
    f AS (
        SELECT file, '8' AS rule, 'error' AS severity, sum(CASE WHEN c_custkey % 7 = 0 THEN times ELSE 0 END) + sum(CASE WHEN times > 1 THEN times ELSE 0 END) AS n FROM c GROUP BY file
        UNION ALL SELECT file, '10a', 'error', sum(CASE WHEN times > 1 THEN times ELSE 0 END) FROM c GROUP BY file
        UNION ALL SELECT file, '10b', 'error', sum(CASE WHEN c_custkey % 11 = 0 THEN times ELSE 0 END) FROM c GROUP BY file
        UNION ALL SELECT file, '10c', 'error', count(*) FILTER (WHERE c_custkey % 13 = 0) FROM c GROUP BY file
        UNION ALL SELECT file, '16', 'error', max(CASE WHEN c_mktsegment = '{_KINDS[-1]}' THEN 1 ELSE 0 END) FROM c GROUP BY file
        UNION ALL SELECT file, '16', 'fyi', {len(_KINDS) - 1} FROM c GROUP BY file)
    SELECT file, rule, severity, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def delivery_findings(spark, sf_dir):
    """All rules over all files: numbers of other precision, ids and keys twice, required cells blank, rows without a parent, codes not listed, or not standard."""
    made = contents(
        t(spark, sf_dir, "customer"), gl="if(c_custkey % 7 = 0, format_string('%.1f', c_acctbal), format_string('%.2f', c_acctbal))", rem="if(c_custkey % 11 = 0, '', c_name)",
        parent="if(c_custkey % 13 = 0, concat(c_custkey, 'x'), string(c_custkey))", times="if(c_custkey % 17 = 0, 2, 1)",
    )
    return rules.validate(delivery.scan_contents(made).cache(), dictionary()).groupBy("file", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


_OTHER = {"gl": "format_string('%.2f', if(c_custkey % 5 = 0, c_acctbal + 1, c_acctbal))", "key": "if(c_custkey % 9 = 0, concat(c_custkey, 'n'), string(c_custkey))", "turned": True}


@query("""
    SELECT kind, count(*) AS n FROM (
        SELECT 'added' AS kind FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'removed' FROM customer WHERE c_custkey % 9 = 0
        UNION ALL SELECT 'changed' FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 = 0) GROUP BY 1""")
def delivery_diff(spark, sf_dir):
    """Two deliveries of all customers, of which the later has other keys, levels and order of headings."""
    *_, both = merge_files.diff(_delivery(spark, sf_dir), _delivery(spark, sf_dir, **_OTHER), dictionary())
    return both["LOCA"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 5 = 0 THEN printf('%.2f', c_acctbal + 1) ELSE printf('%.2f', c_acctbal) END AS level FROM customer
    UNION ALL SELECT c_custkey || 'n', CASE WHEN c_custkey % 5 = 0 THEN printf('%.2f', c_acctbal + 1) ELSE printf('%.2f', c_acctbal) END FROM customer WHERE c_custkey % 9 = 0""")
def delivery_merge(spark, sf_dir):
    """The later delivery's cells win; rows of either stay."""
    blocks = merge_files.merge([_delivery(spark, sf_dir), _delivery(spark, sf_dir, **_OTHER)], dictionary())
    loca = next(b for b in blocks if b.group == "LOCA").frame
    return loca.select(F.col("LOCA_ID").alias("id"), F.col("LOCA_GL").alias("level"))


@query(f"SELECT {_FILE_SQL} AS file, count(*) AS numbers FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1")
def delivery_fix(spark, sf_dir):
    """Numbers written again under their type, file by file."""
    made = contents(t(spark, sf_dir, "customer"), gl="if(c_custkey % 7 = 0, format_string('%.1f', c_acctbal), format_string('%.2f', c_acctbal))")
    done = fix.fixed(made).select(F.col("path").alias("file"), F.col("repairs")["numbers"].cast("long").alias("numbers"))
    return done.where("numbers is not null")


@query("""SELECT '"DATA","' || c_custkey || '","' || c_mktsegment || '","' || printf('%.2f', c_acctbal) || '","' || c_name || '"' || chr(13) || chr(10) AS text FROM customer""")
def delivery_lines(spark, sf_dir):
    """A typed frame as the DATA lines of its group."""
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("LOCA_ID"), F.col("c_mktsegment").alias("LOCA_TYPE"), F.col("c_acctbal").alias("LOCA_GL"), F.col("c_name").alias("LOCA_REM"))
    return emit.lines(emit.typed_block("LOCA", rows, dictionary()))


@query("""
    SELECT c_custkey, '[REDACTED]' AS who, 'kept (' || c_name || ') [REDACTED] [ ]' AS note, '' AS blank, substr(sha256('file'), 1, 8) AS source FROM customer""")
def censor_cells(spark, sf_dir):
    """Cells by policy: token, brackets, blank, hash of the file."""
    rows = t(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name who", "concat('kept (', c_name, ') [', c_mktsegment, '] [ ]') note", "c_name blank", "c_name source")
    return censor.censor(rows, {"who": "token", "note": "brackets", "blank": "blank", "source": "filehash"}, "c_custkey", file_id="file")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 13 <> 0")
def delivery_attached(spark, sf_dir):
    """Rows that hang on a parent row; orphans are left out."""
    d = _delivery(spark, sf_dir, parent="if(c_custkey % 13 = 0, concat(c_custkey, 'x'), string(c_custkey))", turned=True)
    return views.attached(d)["SAMP"].select(F.col("LOCA_ID").alias("id"))


@query("SELECT 'LOCA' AS tbl, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey IN (3, 5, 8) UNION ALL SELECT 'SAMP', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey IN (3, 5, 8)")
def delivery_selection(spark, sf_dir):
    """Two selections add up in every group that has the key."""
    one = views.Selection(_delivery(spark, sf_dir, turned=True)).at("LOCA", ["3", "5", "8", "13"]).at("LOCA", ["2", "3", "5", "8"])
    found = [one[g].select(F.lit(g).alias("tbl"), F.col("LOCA_ID").alias("id")) for g in ("LOCA", "SAMP")]
    return found[0].unionByName(found[1])
