"""Writing grouped text: canonical blocks, metadata synthesis, spreadsheets, renders.

A group's rows become text in Spark, numbered per partition after a range sort; only the
last step that needs one file streams them through the driver, group by group.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..sources import lexer
from ..sources.dictionary import Dictionary

MODES = ("strict", "report", "autofix", "unchecked")


@dataclass
class Block:
    """A group to write: text cells by heading, in ``order``."""

    group: str
    frame: DataFrame
    headings: list[str]
    units: list[str]
    types: list[str]
    order: Sequence[str] = ()


def quote(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def line(*cells: str) -> str:
    return ",".join(map(quote, cells)) + "\r\n"


def cell_text(c: Column, code: str, unit: str = "") -> Column:
    """Any column as the text of its type: numbers under their code, times at the precision of their unit."""
    kind = values.canonical(code)
    if kind == "decimal":
        return values.formatted(c.cast("double"), code)
    if kind == "integer":
        return F.bround(c.cast("double")).cast("decimal(38,0)").cast("string")
    if kind == "boolean":
        return F.when(c.cast("string").isin("true", "Y"), "Y").when(c.cast("string").isin("false", "N"), "N").otherwise(c.cast("string"))
    if kind == "datetime":
        layout = unit.strip() or "yyyy-mm-dd"
        out, hours = "", False
        for piece in re.findall(r"yyyy|sss|mm|dd|hh|ss|.", layout.lower()):
            hours = hours or piece == "hh"
            out += {"mm": "mm" if hours else "MM", "hh": "HH", "sss": "SSS", "t": "'T'"}.get(piece, piece)
        return F.when(c.try_cast("timestamp_ntz").isNull(), c.cast("string")).otherwise(F.date_format(c.try_cast("timestamp_ntz"), out))
    return c.cast("string")


def typed_block(group: str, frame: DataFrame, dictionary: Dictionary, units: Mapping[str, str] | None = None, types: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> Block:
    """A block from any frame: units and types from the caller, else the dictionary, else the parents', else '' and X."""
    headings = [c for c in frame.columns if not c.startswith("_")]
    known = {h.name: i for i, h in enumerate(dictionary.headings.get(group, []))}
    headings.sort(key=lambda h: known.get(h, len(known)))

    def of(h: str, given: Mapping[str, str] | None, what: str, default: str) -> str:
        if given and h in given:
            return given[h]
        for g in (group, *dictionary.ancestors(group)):
            if (x := dictionary.heading(g, h)) is not None:
                return getattr(x, what) or default
        return default

    u = [of(h, units, "unit", "") for h in headings]
    t = [of(h, types, "type", "X") for h in headings]
    made = frame.select(*[c for c in order if c not in headings], *[F.coalesce(cell_text(F.col(f"`{h}`"), k, n), F.lit("")).alias(h) for h, k, n in zip(headings, t, u)])
    return Block(group, made, headings, u, t, order)


def lines(block: Block) -> DataFrame:
    """The block's DATA rows as lines of text, in order."""
    cells = [values.quoted(F.coalesce(F.col(f"`{h}`"), F.lit(""))) for h in block.headings]
    rows = block.frame.orderBy(*block.order) if block.order else block.frame
    return rows.select(F.concat(F.lit('"DATA",'), F.concat_ws(",", *cells), F.lit("\r\n")).alias("text"))


def head(block: Block) -> str:
    return line("GROUP", block.group) + line("HEADING", *block.headings) + line("UNIT", *block.units) + line("TYPE", *block.types)


def chunks(blocks: Sequence[Block]) -> Iterator[str]:
    """The file, piece by piece; blank lines between groups."""
    for i, b in enumerate(blocks):
        yield ("\r\n" if i else "") + head(b)
        for r in lines(b).toLocalIterator(prefetchPartitions=True):
            yield r["text"]


def write(blocks: Sequence[Block], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        for piece in chunks(blocks):
            f.write(piece)


def to_text(blocks: Sequence[Block]) -> str:
    return "".join(chunks(blocks))


def used_codes(blocks: Sequence[Block], joiner: str = "+") -> DataFrame:
    """(kind, heading, code): distinct units, types and abbreviation parts in use."""
    spark = blocks[0].frame.sparkSession
    fixed = {("unit", "", u) for b in blocks for u in b.units if u} | {("type", "", t) for b in blocks for t in b.types if t}
    out = spark.createDataFrame(sorted(fixed), "kind string, heading string, code string")
    for b in blocks:
        for h, t in zip(b.headings, b.types):
            if t.upper() in ("PA", "PU"):
                parts = F.explode(F.split(F.col(f"`{h}`"), f"\\Q{joiner}\\E")) if t.upper() == "PA" else F.col(f"`{h}`")
                found = b.frame.select(parts.alias("code")).where("code <> ''").distinct()
                out = out.unionByName(found.select(F.lit("abbr" if t.upper() == "PA" else "unit").alias("kind"), F.lit(h if t.upper() == "PA" else "").alias("heading"), "code"))
    return out.distinct()


def synthesised(blocks: Sequence[Block], dictionary: Dictionary, stamp: Mapping[str, str] | None = None) -> list[Block]:
    """The blocks with UNIT, TYPE and ABBR groups for the codes in use, and TRAN from ``stamp``; given groups stay. Code lists are small."""
    spark = blocks[0].frame.sparkSession
    have = {b.group for b in blocks}
    codes = [tuple(r) for r in used_codes(blocks).orderBy("kind", "heading", "code").collect()]
    tables = {
        "UNIT": (["UNIT_UNIT", "UNIT_DESC"], [(c, dictionary.units.get(c, "")) for k, _, c in codes if k == "unit"]),
        "TYPE": (["TYPE_TYPE", "TYPE_DESC"], [(c, dictionary.types.get(c, "")) for c in sorted({c for k, _, c in codes if k == "type"} | {"X"})]),
        "ABBR": (["ABBR_HDNG", "ABBR_CODE", "ABBR_DESC"], [(h, c, dictionary.abbreviations.get((h, c), "")) for k, h, c in codes if k == "abbr"]),
    }
    out = []
    if stamp and "TRAN" not in have:
        names = list(stamp)
        out.append(Block("TRAN", spark.createDataFrame([tuple(stamp.values())], ", ".join(f"{n} string" for n in names)), names, [""] * len(names), ["X"] * len(names)))
    out += blocks
    for group, (names, rows) in tables.items():
        if group not in have and rows:
            out.append(Block(group, spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), names, [""] * len(names), ["X"] * len(names), names[:2]))
    return out


def pruned_dict(declared: DataFrame, standard: DataFrame, used: DataFrame) -> DataFrame:
    """DICT rows that neither restate the standard nor define what the file lacks; all by (group, heading)."""
    keys = ["group", "heading"]
    return declared.join(standard.select(*keys).distinct(), keys, "left_anti").join(used.select(*keys).distinct(), keys, "left_semi")


def build(blocks: Sequence[Block], dictionary: Dictionary, mode: str = "strict", stamp: Mapping[str, str] | None = None) -> tuple[str, DataFrame | None]:
    """Text and its findings: strict raises on errors, report returns them, autofix applies safe fixes first, unchecked skips rules."""
    from ..sources import delivery
    from . import fix, rules

    text = to_text(synthesised(blocks, dictionary, stamp))
    if mode == "unchecked":
        return text, None
    spark = blocks[0].frame.sparkSession
    if mode == "autofix":
        text = fix.fixed_text(text)[0]
    findings = rules.validate(delivery.scan_text(spark, text), dictionary)
    if mode == "strict" and (bad := findings.where("severity = 'error'").take(5)):
        raise lexer.DeliveryError("Invalid", "; ".join(f"{r['rule']} line {r['line']}: {r['desc']}" for r in bad))
    return text, findings


# -- renders --------------------------------------------------------------------------------


def rows_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def rows_csv(df: DataFrame) -> Iterator[str]:
    """Lines of CSV, quoted only where needed."""
    def one(cells: Sequence) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if c is None else c for c in cells])
        return out.getvalue()

    yield one(df.columns)
    for r in df.toLocalIterator():
        yield one(list(r))


def export(df: DataFrame, path: str, form: str) -> None:
    """A query's result as csv, json or parquet."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", "true") if form == "csv" else writer).format(form).save(path)


def report_by_rule(findings: DataFrame) -> DataFrame:
    """(rule, n, findings): every finding of each rule, nested."""
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("line", "group", "severity", "desc"))).alias("findings"))


def geojson(df: DataFrame, longitude: str, latitude: str, properties: Sequence[str]) -> str:
    """A FeatureCollection; points without finite coordinates are left out, coordinates rounded to 8 decimals."""
    fine = df.where(F.col(longitude).between(-180, 180) & F.col(latitude).between(-90, 90))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(longitude, 8), F.round(latitude, 8)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in fine.select(feature).toLocalIterator()) + "]}"


# -- spreadsheets ---------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, d = divmod(i - 1, 26)
        out = chr(65 + d) + out
    return out


def write_xlsx(blocks: Sequence[Block], path: str) -> None:
    """One sheet for each group: HEADING, UNIT, TYPE and DATA rows as text."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<sheet name="{escape(b.group)}" sheetId="{i}" r:id="rId{i}"/>' for i, b in enumerate(blocks, 1))
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(blocks) + 1)) + "</Types>")
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(blocks) + 1)) + "</Relationships>")
        for i, b in enumerate(blocks, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                widths = "".join(f'<col min="{k}" max="{k}" width="{min(max(13, len(h) + 1), 75)}" customWidth="1"/>' for k, h in enumerate(["HEADING", *b.headings], 1))
                f.write(f'<worksheet xmlns="{_NS["m"]}"><cols>{widths}</cols><sheetData>'.encode())
                top = [["HEADING", *b.headings], ["UNIT", *b.units], ["TYPE", *b.types]]
                rows = b.frame.orderBy(*b.order) if b.order else b.frame
                data = (["DATA", *[r[h] or "" for h in b.headings]] for r in rows.select(*[f"`{h}`" for h in b.headings]).toLocalIterator())
                for n, cells in enumerate((*top, *data), 1):
                    f.write(f'<row r="{n}">{"".join(f"""<c r="{_column(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>""" for k, v in enumerate(cells))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")


def read_xlsx(spark: SparkSession, path: str) -> list[Block]:
    """Groups of a workbook: sheets with a HEADING column, rows tagged UNIT, TYPE or DATA, headings of fit names."""
    out = []
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).find("m:sheetData", _NS):
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r"))[0]:
                        at = at * 26 + ord(ch) - 64
                    v = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells[at - 1] = re.sub(r"\.0\Z", "", text) if c.get("t") in (None, "n") else text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            if not rows or "HEADING" not in rows[0]:
                continue
            tag = rows[0].index("HEADING")
            keep = [i for i, h in enumerate(rows[0]) if re.fullmatch(r"[A-Z0-9_]{1,9}", h) and i != tag]
            of = {t: [[r[i] if i < len(r) else "" for i in keep] for r in rows[1:] if len(r) > tag and r[tag] == t] for t in ("UNIT", "TYPE", "DATA")}
            names = [rows[0][i] for i in keep]
            blank = [""] * len(names)
            frame = spark.createDataFrame([(n, *r) for n, r in enumerate(of["DATA"])], ", ".join(["_row int", *[f"`{n}` string" for n in names]]))
            out.append(Block(sheet.get("name"), frame, names, (of["UNIT"] or [blank])[0], (of["TYPE"] or [["X"] * len(names)])[0], ["_row"]))
    return out
