"""The numbered validation rules, each a query over the records of any number of files.

All rules see the same frames: ``records`` (every record), ``heads`` (one row for each file
and group with its headings, units and types) and ``data`` (DATA rows with their group's
headings). Every join is by file, so a corpus is checked in one plan; only the dictionary,
whose size its file bounds, is broadcast.

Findings: file, rule, severity (error, warning, fyi), line, group, desc.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..sources import lexer
from ..sources.dictionary import Dictionary

#: Groups without a parent, editions, and groups whose headings any group may borrow.
ROOTS = ("PROJ", "TRAN", "ABBR", "DICT", "UNIT", "TYPE", "FILE", "LOCA", "STND", "LBSG", "PREM")
EDITIONS = ("4.0.3", "4.0.4", "4.1", "4.1.1", "4.2")
BORROWED = ("SPEC", "TEST")
FREE_TYPES = ("MC", "RL", "X", "XN", "PA", "PT", "PU")
FINDING = "file string, rule string, severity string, line int, `group` string, desc string"
#: The first and last year of a nanosecond clock.
YEARS = (1677, 2262)

RULES: dict[str, Callable[[Check], list[DataFrame]]] = {}


def rule(*names: str):
    def add(f):
        for n in names:
            RULES[n] = f
        return f

    return add


class Check:
    """The frames that rules read."""

    def __init__(self, records: DataFrame, dictionary: Dictionary, edition: str = "", files_root: str | None = None):
        self.spark = records.sparkSession
        self.records = records
        self.dictionary, self.edition, self.files_root = dictionary, edition or dictionary.edition, files_root
        first = records.where(F.col("tag").isin("HEADING", "UNIT", "TYPE") & F.col("group").isNotNull()).groupBy("file", "group")

        def of(tag: str, what: str) -> Column:
            return F.min_by(F.when(F.col("tag") == tag, F.col(what)), F.when(F.col("tag") == tag, F.col("rec")))

        heads = first.agg(*[of(t, w).alias(f"{t.lower()}_{w}") for t in ("HEADING", "UNIT", "TYPE") for w in ("values", "line", "rec")])
        trim = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x))
        self.heads = heads.select("file", "group", trim(F.col("heading_values")).alias("headings"), trim(F.col("unit_values")).alias("units"), trim(F.col("type_values")).alias("types"), *[c for c in heads.columns if c.endswith(("_line", "_rec"))]).cache()
        data = records.where("tag = 'DATA' and `group` is not null").select("file", "group", "line", "data_row", "values", "text")
        self.data = data.join(self.heads.select("file", "group", "headings", "units", "types"), ["file", "group"]).cache()
        self.standard = self.spark.createDataFrame(
            [(g, h.name, h.status, h.type, h.unit, h.ordinal) for g, hs in dictionary.headings.items() for h in hs], "std_group string, std_heading string, status string, std_type string, std_unit string, ordinal int"
        )

    def cell(self, heading: str | Column) -> Column:
        """A DATA row's raw cell by heading; null if absent."""
        return F.get("values", F.array_position("headings", heading).cast("int") - 1)

    def rows(self, group: str) -> DataFrame:
        return self.data.where(F.col("group") == group)

    def cells(self) -> DataFrame:
        """(file, group, line, heading, unit, type, value) of every cell that isn't blank."""
        zipped = F.posexplode("headings").alias("i", "heading")
        out = self.data.select("file", "group", "line", "values", "units", "types", zipped)
        out = out.select("file", "group", "line", "i", "heading", F.coalesce(F.get("units", F.col("i")), F.lit("")).alias("unit"), F.coalesce(F.get("types", F.col("i")), F.lit("X")).alias("type"), F.get("values", F.col("i")).alias("value"))
        return out.where("value is not null and trim(value) <> ''")

    def used(self) -> DataFrame:
        """(file, group, heading, i, unit, type, line) of every heading in use."""
        out = self.heads.select("file", "group", "heading_line", "units", "types", F.posexplode("headings").alias("i", "heading"))
        return out.select("file", "group", "heading", "i", F.coalesce(F.get("units", F.col("i")), F.lit("")).alias("unit"), F.coalesce(F.get("types", F.col("i")), F.lit("")).alias("type"), F.col("heading_line").alias("line"))

    def declared(self) -> DataFrame:
        """(file, group, heading, status, type) that the files' own DICT rows declare."""
        d = self.rows("DICT").where(F.upper(F.trim(self.cell("DICT_TYPE"))) == "HEADING")
        return d.select("file", F.trim(self.cell("DICT_GRP")).alias("dict_group"), F.trim(self.cell("DICT_HDNG")).alias("dict_heading"), F.trim(self.cell("DICT_STAT")).alias("dict_status"), F.trim(self.cell("DICT_DTYP")).alias("dict_type"), "line")

    def unknown(self) -> DataFrame:
        """Headings in use that neither the standard nor the file declares."""
        used = self.used()
        out = used.join(F.broadcast(self.standard), (used["group"] == self.standard["std_group"]) & (used["heading"] == self.standard["std_heading"]), "left_anti")
        own = self.declared().select(F.col("file").alias("of"), "dict_group", "dict_heading")
        return out.join(own, (out["file"] == own["of"]) & (out["group"] == own["dict_group"]) & (out["heading"] == own["dict_heading"]), "left_anti")

    def files(self) -> DataFrame:
        return self.records.select("file").distinct()


def found(df: DataFrame, name: str, desc: Column | str, severity: str = "error", line: Column | str | None = "line", group: Column | str = "group") -> DataFrame:
    text = desc if isinstance(desc, Column) else F.lit(desc)
    as_col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    return df.select("file", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), as_col(line).cast("int").alias("line"), as_col(group).cast("string").alias("group"), text.alias("desc"))


@rule("1")
def characters(c: Check) -> list[DataFrame]:
    beyond = c.records.where(F.col("text").rlike("[^\\x{0}-\\x{FF}]"))
    upper = c.records.where(F.col("text").rlike("[\\x{80}-\\x{FF}]") & ~F.col("text").rlike("[^\\x{0}-\\x{FF}]"))
    bom = c.records.where("rec = 0 and byte_offset = 3")
    return [found(beyond, "1", "character beyond the extended ASCII range"), found(upper, "1", "extended ASCII character", "fyi"), found(bom, "1", "byte-order mark")]


@rule("2")
def group_rows(c: Check) -> list[DataFrame]:
    groups = c.records.where("tag = 'GROUP'").groupBy("file", "group").agg(F.min("line").alias("line"))
    filled = c.records.where("tag = 'DATA'").select("file", "group").distinct()
    orphan = c.records.where("`group` is null and tag in ('HEADING', 'UNIT', 'TYPE', 'DATA')")
    return [found(groups.join(filled, ["file", "group"], "left_anti"), "2", "group has no DATA row"), found(orphan, "2", "row before the first GROUP")]


@rule("2a")
def line_ends(c: Check) -> list[DataFrame]:
    return [found(c.records.where("terminator <> '\\r\\n'"), "2a", "line does not end in CR LF")]


@rule("2b")
def descriptor_order(c: Check) -> list[DataFrame]:
    unit = c.heads.where("heading_rec is not null and (unit_rec is null or unit_rec <> heading_rec + 1)")
    kind = c.heads.where("heading_rec is not null and (type_rec is null or type_rec <> coalesce(unit_rec, heading_rec) + 1)")
    return [found(unit, "2b", "UNIT row is missing or not below HEADING", line="heading_line"), found(kind, "2b", "TYPE row is missing or not below UNIT", line="heading_line")]


@rule("3")
def descriptors(c: Check) -> list[DataFrame]:
    return [found(c.records.where(~F.col("tag").isin(*lexer.TAGS)), "3", "row does not start with a descriptor")]


@rule("4")
def field_counts(c: Check) -> list[DataFrame]:
    group = c.records.where("tag = 'GROUP' and size(values) <> 1")
    rows = c.records.where(F.col("tag").isin("UNIT", "TYPE", "DATA")).join(c.heads.select("file", "group", "headings"), ["file", "group"])
    wrong = rows.where("size(values) <> size(headings)")
    return [found(group, "4", "GROUP row has not one item"), found(wrong, "4", F.concat(F.lit("row has "), F.size("values").cast("string"), F.lit(" fields, HEADING "), F.size("headings").cast("string")))]


@rule("5")
def quoting(c: Check) -> list[DataFrame]:
    strict = F.col("text").rlike('^"(?:[^"]|"")*+"(?:,"(?:[^"]|"")*+")*+\\z')
    bad = c.records.where(~strict & (F.trim("text") != ""))
    embedded = F.when(F.col("text").rlike('^".*"$'), "quote inside a field is not doubled").otherwise("field is not enclosed in quotes")
    return [found(bad, "5", embedded)]


@rule("6")
def one_line(c: Check) -> list[DataFrame]:
    return [found(c.records.where(F.col("text").rlike("[\\r\\n]")), "6", "line break inside a row")]


@rule("7")
def heading_order(c: Check) -> list[DataFrame]:
    twice = c.heads.where("size(array_distinct(headings)) < size(headings)")
    used = c.used()
    known = used.join(F.broadcast(c.standard), (used["group"] == c.standard["std_group"]) & (used["heading"] == c.standard["std_heading"]), "left")
    back = known.withColumn("before", F.max("ordinal").over(Window.partitionBy("file", "group").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    state = back.groupBy("file", "group").agg(F.min("line").alias("line"), F.bool_or(F.col("ordinal").isNull()).alias("unknown"), F.bool_or(F.col("ordinal") < F.col("before")).alias("back"))
    return [found(twice, "7", "heading occurs twice", line="heading_line"), found(state.where("not unknown and back"), "7", "headings are not in dictionary order")]


_DATE_PARTS = {"yyyy": r"(?P<y>[0-9]{4})", "mm": None, "dd": r"(?P<d>[0-9]{2})", "hh": r"(?P<h>[0-9]{2})", "ss": r"(?P<s>[0-9]{2})", "sss": r"[0-9]{3}"}


def date_fits(value: str, unit: str) -> bool:
    """Whether a cell has the shape of its UNIT and is a date in range; mm is months until hh."""
    pattern, hours = "", False
    for piece in re.findall(r"yyyy|sss|mm|dd|hh|ss|.", unit.strip().lower()):
        if piece == "mm":
            pattern += r"(?P<n>[0-9]{2})" if hours else r"(?P<m>[0-9]{2})"
        elif piece in _DATE_PARTS:
            hours = hours or piece == "hh"
            pattern += _DATE_PARTS[piece]
        else:
            pattern += re.escape(piece)
    try:
        m = re.fullmatch(pattern, value, re.I)
        if not m:
            return False
        g = {k: int(v) for k, v in m.groupdict().items()}
        if "y" in g:
            at = pd.Timestamp(year=g["y"], month=g.get("m", 1), day=g.get("d", 1)) if YEARS[0] <= g["y"] <= YEARS[1] else None
            return at is not None and g.get("h", 0) < 24 and g.get("n", 0) < 60 and g.get("s", 0) < 60
        return g.get("h", 0) < 24 and g.get("n", 0) < 60 and g.get("s", 0) < 60
    except (ValueError, re.error):
        return False


@F.pandas_udf(T.BooleanType())
def _fits_python(value: pd.Series, kind: pd.Series, unit: pd.Series) -> pd.Series:
    """Types that need more than a pattern: significant figures and dates."""

    def one(v: str, t: str, u: str) -> bool:
        if t == "DT":
            return date_fits(v, u)
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v):
            return False
        return values.formatter(t)(float(v)) == v

    return pd.Series([one(v, t, u) for v, t, u in zip(value, kind, unit)], dtype=bool)


@rule("8")
def cell_types(c: Check) -> list[DataFrame]:
    t = F.upper(F.trim("type"))
    cells = c.cells().withColumn("t", t).where(~F.col("t").isin(*FREE_TYPES))
    n = F.regexp_extract("t", "^([0-9]+)(DP|SCI)$", 1)
    decimals = F.when(n == "0", F.col("value").rlike("^-?[0-9]+\\.?\\z")).otherwise(F.col("value").rlike("^-?[0-9]+\\.[0-9]+\\z") & (F.length(F.substring_index("value", ".", -1)) == n.try_cast("int")))
    science = F.col("value").rlike("^-?[0-9]\\.[0-9]*[eE][+-]?[0-9]+\\z") & (F.length(F.regexp_extract("value", "\\.([0-9]*)", 1)) == n.try_cast("int"))
    fits = (
        F.when(F.col("t").rlike("^[0-9]+DP\\z"), decimals).when(F.col("t").rlike("^[0-9]+SCI\\z"), science)
        .when(F.col("t") == "YN", F.upper(F.trim("value")).isin("Y", "N")).when(F.col("t") == "DMS", values.is_dms(F.col("value"))).when(F.col("t") == "T", values.is_elapsed(F.col("value"), F.col("unit")))
    )
    plain = cells.where(~F.col("t").rlike("^[0-9]+SF\\z") & (F.col("t") != "DT")).where(~F.coalesce(fits, F.lit(True)))
    hard = cells.where(F.col("t").rlike("^[0-9]+SF\\z") | (F.col("t") == "DT"))
    hard = hard.where(~_fits_python("value", "t", "unit"))
    what = F.concat(F.col("heading"), F.lit(": "), F.col("value"), F.lit(" is not of type "), F.col("t"), F.when(F.col("unit") != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(""))
    own = c.cells().where((F.upper(F.trim("type")) == "ID") & (F.col("heading") == F.concat(F.col("group"), F.lit("_ID"))))
    alone = own.join(c.heads.select("file", "group", "headings"), ["file", "group"])
    # an ID alone identifies a row only where no other key does
    single = [g for g in c.dictionary.groups if c.dictionary.key_chain(g) == [f"{g}_ID"]]
    w = Window.partitionBy("file", "group", "value")
    twice = alone.where(F.col("group").isin(single)).withColumn("times", F.count(F.lit(1)).over(w)).where("times > 1")
    used = c.used().where("type <> ''")
    drift = used.join(F.broadcast(c.standard), (used["group"] == c.standard["std_group"]) & (used["heading"] == c.standard["std_heading"])).where(F.upper(F.trim("type")) != F.upper(F.trim("std_type")))
    shared = {h for h in {x.name for hs in c.dictionary.headings.values() for x in hs if x.is_key} if sum(x.is_key for x in c.dictionary.anywhere(h)) >= 2}
    join_key = F.col("heading").isin(sorted(shared)) if shared else F.lit(False)
    text = F.concat(F.col("heading"), F.lit(" has type "), F.col("type"), F.lit(", the dictionary "), F.col("std_type"))
    return [found(plain, "8", what), found(hard, "8", what), found(twice, "8", F.concat(F.col("heading"), F.lit(" is not unique: "), F.col("value"))), found(drift.where(join_key), "8", text, "warning"), found(drift.where(~join_key), "8", text, "fyi")]


@rule("9", "18")
def headings_known(c: Check) -> list[DataFrame]:
    unknown = c.unknown()
    no_dict = unknown.select("file").distinct().join(c.rows("DICT").select("file").distinct(), "file", "left_anti")
    known_types = F.upper(F.trim(c.cell("DICT_TYPE"))).isin("GROUP", "HEADING")
    malformed = c.rows("DICT").where(~F.coalesce(known_types, F.lit(False)) | (F.coalesce(F.trim(c.cell("DICT_GRP")), F.lit("")) == "") | ((F.upper(F.trim(c.cell("DICT_TYPE"))) == "HEADING") & (F.coalesce(F.trim(c.cell("DICT_HDNG")), F.lit("")) == "")))
    own = c.declared()
    again = own.join(F.broadcast(c.standard), (own["dict_group"] == c.standard["std_group"]) & (own["dict_heading"] == c.standard["std_heading"]))
    return [
        found(unknown, "9", F.concat(F.col("heading"), F.lit(" is in no dictionary"))), found(no_dict, "18", "headings are not standard and there is no DICT group", line=None, group=F.lit("DICT")),
        found(malformed, "18", "DICT row without a type, group or heading", "warning"), found(again, "18", F.concat(F.col("dict_heading"), F.lit(" restates the standard")), "fyi", group=F.lit("DICT")),
    ]


@rule("10a", "10b", "10c")
def keys_rules(c: Check) -> list[DataFrame]:
    d = c.dictionary
    schema = "k_group string, chain array<string>, required array<string>, parent string, above array<string>, foreign array<string>"
    rows = []
    for g in d.groups:
        parent = d.parent(g) if g not in ROOTS else None
        above = d.key_chain(parent) or []
        if not above or set(above) - {h.name for h in d.headings.get(g, [])}:
            parent, above = None, []
        up = {*d.ancestors(g), g}
        foreign = [h.name for h in d.headings.get(g, []) if h.is_key and (o := h.name.split("_")[0]) in d.groups and o not in up]
        rows.append((g, d.key_chain(g) or [], [h.name for h in d.headings.get(g, []) if h.is_required], parent, above, foreign))
    keys = F.broadcast(c.spark.createDataFrame(rows, schema))
    heads = c.heads.join(keys, F.col("group") == F.col("k_group"))
    data = c.data.join(keys, F.col("group") == F.col("k_group"))
    # an absent cell is blank
    of = lambda names: F.transform(names, lambda h: F.coalesce(F.get("values", F.array_position("headings", h).cast("int") - 1), F.lit("")))
    missing = lambda names: F.explode(F.array_except(names, F.col("headings"))).alias("name")
    no_key = heads.select("file", "group", "heading_line", missing(F.col("chain")))
    no_required = heads.select("file", "group", "heading_line", missing(F.col("required")))

    keyed = data.where("size(chain) > 0").withColumn("key", of(F.col("chain")))
    counts = keyed.groupBy("file", "group", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = keyed.join(counts, ["file", "group", "key"])

    blank = data.select("file", "group", "line", "values", "headings", F.explode(F.array_intersect("required", "headings")).alias("name"))
    blank = blank.where(F.trim(F.coalesce(F.get("values", F.array_position("headings", F.col("name")).cast("int") - 1), F.lit(""))) == "")
    echo = F.transform(F.arrays_zip("headings", "values"), lambda z: F.when(z["headings"] == F.col("name"), F.concat(F.lit("??"), z["headings"], F.lit("??"))).otherwise(F.coalesce(z["values"], F.lit(""))))

    child = data.where("parent is not null").withColumn("key", of(F.col("above")))
    empty = F.forall("key", lambda x: F.trim(x) == "")
    wanted = keys.where("size(above) > 0").select(F.col("parent").alias("p"), F.col("above").alias("p_above")).distinct()
    theirs = c.data.join(F.broadcast(wanted), F.col("group") == F.col("p")).select("file", F.col("p").alias("parent"), F.col("p_above").alias("above"), of(F.col("p_above")).alias("key")).distinct()
    lost = child.where(~empty).join(theirs, ["file", "parent", "above", "key"], "left_anti")

    owners = heads.select("file", "group", "heading_line", F.explode(F.array_intersect("foreign", "headings")).alias("name"))
    here = c.heads.select("file", F.col("group").alias("owner")).distinct()
    owned = owners.withColumn("owner", F.substring_index("name", "_", 1)).join(here, ["file", "owner"])
    return [
        found(no_key, "10a", F.concat(F.lit("KEY heading "), F.col("name"), F.lit(" is missing")), line="heading_line"), found(twice, "10a", F.concat(F.lit("duplicate key "), F.array_join("key", "|"))),
        found(no_required, "10b", F.concat(F.lit("REQUIRED heading "), F.col("name"), F.lit(" is missing")), line="heading_line"),
        found(blank, "10b", F.concat(F.lit("REQUIRED "), F.col("name"), F.lit(" is blank: "), F.array_join(echo, "|"))),
        found(child.where(empty), "10c", F.concat(F.lit("no key of parent "), F.col("parent")), "warning"), found(lost, "10c", F.concat(F.lit("no "), F.col("parent"), F.lit(" row with "), F.array_join("key", "|"))),
        found(owned, "10c", F.concat(F.lit("KEY "), F.col("name"), F.lit(" is owned by "), F.col("owner"), F.lit(", outside the parent chain")), "fyi", line="heading_line"),
    ]


def _tran(c: Check, heading: str) -> DataFrame:
    """(file, value) of a heading in the first TRAN row."""
    rows = c.rows("TRAN").where(F.array_contains("headings", heading))
    return rows.groupBy("file").agg(F.min_by(F.coalesce(F.trim(c.cell(heading)), F.lit("")), "data_row").alias("value"), F.min("line").alias("line"))


@rule("11")
def links(c: Check) -> list[DataFrame]:
    out = [found(_tran(c, h).where("value = ''"), r, f"{h} is blank", group=F.lit("TRAN")) for r, h in (("11a", "TRAN_DLIM"), ("11b", "TRAN_RCON"))]
    # links of files that don't say how these are written can't be read
    delimiter = _tran(c, "TRAN_DLIM").where("value <> ''").select("file", F.col("value").alias("dlim"))
    joiner = _tran(c, "TRAN_RCON").where("value <> ''").select("file", F.col("value").alias("rcon"))
    cells = c.cells().where("upper(trim(type)) = 'RL'").join(delimiter, "file").join(joiner, "file")
    quote = lambda x: F.concat(F.lit("\\Q"), F.col(x), F.lit("\\E"))
    one = cells.withColumn("link", F.explode(F.split("value", quote("rcon")))).withColumn("parts", F.split("link", quote("dlim")))
    wanted = one.select("file", "line", "group", "link", F.trim(F.col("parts")[0]).alias("target"), F.slice("parts", 2, 1000).alias("key")).withColumn("k", F.size("key"))
    lengths = wanted.select("file", "target", "k").distinct()
    rows = c.data.select("file", F.col("group").alias("target"), "values").join(lengths, ["file", "target"]).where("k > 0")
    hits = rows.select("file", "target", F.slice("values", F.lit(1), F.col("k")).alias("key")).groupBy("file", "target", "key").agg(F.count(F.lit(1)).alias("n"))
    bad = wanted.join(hits, ["file", "target", "key"], "left").where("coalesce(n, 0) <> 1")
    return [*out, found(bad, "11c", F.concat(F.lit("link "), F.col("link"), F.lit(" finds "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows")))]


@rule("13", "14")
def single_groups(c: Check) -> list[DataFrame]:
    out = []
    for name, group in (("13", "PROJ"), ("14", "TRAN")):
        n = c.rows(group).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        out.append(found(c.files().join(n, "file", "left").where("coalesce(n, 0) <> 1"), name, F.concat(F.lit(f"{group} has "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows, not one")), line=None, group=F.lit(group)))
    odd = _tran(c, "TRAN_AGS").where(~F.col("value").isin(*EDITIONS) & (F.col("value") != ""))
    return [*out, found(odd, "14", F.concat(F.lit("unknown edition "), F.col("value")), "warning", group=F.lit("TRAN"))]


def _undefined(c: Check, used: DataFrame, group: str, heading: str, name: str, what: str) -> DataFrame:
    """Distinct (file, value) in use that a group of the same file doesn't define."""
    has = c.rows(group).select("file", F.trim(c.cell(heading)).alias("value")).distinct()
    return found(used.groupBy("file", "value").agg(F.min("line").alias("line"), F.min("group").alias("group")).join(has, ["file", "value"], "left_anti"), name, F.concat(F.lit(f"{what} "), F.col("value"), F.lit(f" is not in {group}")))


@rule("15", "17")
def units_and_types(c: Check) -> list[DataFrame]:
    used = c.used()
    units = used.where("trim(unit) <> ''").select("file", "group", "line", F.trim("unit").alias("value"))
    cells = c.cells().where("upper(trim(type)) = 'PU'").select("file", "group", "line", F.trim("value").alias("value"))
    types = used.where("trim(type) <> ''").select("file", "group", "line", F.trim("type").alias("value"))
    return [_undefined(c, units.unionByName(cells), "UNIT", "UNIT_UNIT", "15", "unit"), _undefined(c, types, "TYPE", "TYPE_TYPE", "17", "type")]


def _hints(dictionary: Dictionary) -> Callable[..., Column]:
    """What a code under a heading that a file doesn't declare may stand for; null where nothing is near."""
    standard: dict[str, list[str]] = {}
    for heading, code in dictionary.abbreviations:
        standard.setdefault(heading, []).append(code)

    def hint(heading: str, part: str, codes: Sequence[str] | None) -> str | None:
        own = [] if codes is None else list(codes)
        if padded := [x for x in own if x.strip() == part.strip()]:
            return f"{heading}: {part} is not in ABBR, but '{padded[0]}' is; they differ by white space around them"
        near = [f"{x} (in ABBR)" for x in values.close_matches(part, own)]
        others = set(standard.get(heading, ())).difference(own)
        near += [f"{x} (standard)" for x in values.close_matches(part, others)]
        return f"{heading}: {part} is not in ABBR; did you mean {' or '.join(near[: values.MOST_HINTS])}?" if near else None

    @F.pandas_udf(T.StringType())
    def hints(heading: pd.Series, part: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series(list(map(hint, heading, part, codes)), dtype=object)

    return hints


@rule("16")
def abbreviations(c: Check) -> list[DataFrame]:
    joiner = _tran(c, "TRAN_RCON").where("value <> ''").select("file", F.col("value").alias("rcon"))
    # values are made distinct before they are cut and looked up
    cells = c.cells().where("upper(trim(type)) = 'PA'").groupBy("file", "heading", "value").agg(F.min("line").alias("line"), F.min("group").alias("group"))
    cut = cells.join(F.broadcast(joiner), "file", "left").withColumn("part", F.explode(F.when(F.col("rcon").isNull(), F.array("value")).otherwise(F.split("value", F.concat(F.lit("\\Q"), F.col("rcon"), F.lit("\\E"))))))
    rows = c.rows("ABBR").select("file", F.trim(c.cell("ABBR_HDNG")).alias("heading"), c.cell("ABBR_CODE").alias("part"), F.coalesce(F.trim(c.cell("ABBR_DESC")), F.lit("")).alias("desc_here"), F.col("line").alias("at"))
    has = rows.select("file", "heading", "part").distinct()
    missing = cut.where("part <> ''").join(has, ["file", "heading", "part"], "left_anti")
    declared = has.groupBy("file", "heading").agg(F.sort_array(F.collect_list("part")).alias("codes"))
    hints = missing.join(declared, ["file", "heading"], "left").withColumn("hint", _hints(c.dictionary)("heading", "part", "codes")).where("hint is not null")
    std = c.spark.createDataFrame([(h, k, d) for (h, k), d in c.dictionary.abbreviations.items()] or [(None, None, None)], "std_h string, std_k string, std_d string")
    known = rows.join(F.broadcast(std), (rows["heading"] == std["std_h"]) & (rows["part"] == std["std_k"]), "left")
    drift = known.where("std_d is not null and lower(std_d) <> lower(desc_here)")
    extra = known.where("std_k is null")
    case = rows.withColumn("forms", F.size(F.collect_set("part").over(Window.partitionBy("file", "heading", F.lower("part"))))).where("forms > 1")
    padded = rows.where("part <> trim(part)")
    abbr = F.lit("ABBR")
    return [
        found(missing, "16", F.concat(F.col("heading"), F.lit(": "), F.col("part"), F.lit(" is not in ABBR"))), found(hints, "16", F.col("hint"), "fyi"), found(drift, "16", F.concat(F.col("part"), F.lit(" is described otherwise in the standard")), "fyi", "at", abbr),
        found(extra, "16", F.concat(F.col("heading"), F.lit(": "), F.col("part"), F.lit(" is not a standard code")), "fyi", "at", abbr),
        found(case, "16", F.concat(F.col("part"), F.lit(" differs from another code by case")), "warning" if c.edition >= "4.2" else "fyi", "at", abbr), found(padded, "16", F.concat(F.col("part"), F.lit(" is padded")), "warning", "at", abbr),
    ]


@rule("19")
def names(c: Check) -> list[DataFrame]:
    groups = c.records.where("tag = 'GROUP'").where(~F.coalesce(F.col("values")[0], F.lit("")).rlike("^[A-Z]{4}\\z"))
    used = c.used()
    long = used.where("length(heading) > 9")
    odd = used.where(~F.col("heading").rlike("^[A-Z0-9_]*\\z"))
    shape = used.where(~F.col("heading").rlike("^[A-Z]{4}_[A-Z0-9]{1,4}\\z"))
    prefix = F.substring("heading", 1, 4)
    borrowed = used.where(F.col("heading").rlike("^[A-Z]{4}_") & (prefix != F.col("group")) & ~prefix.isin(*BORROWED))
    lost = borrowed.join(F.broadcast(c.standard.select("std_group", "std_heading").distinct()), (F.substring(borrowed["heading"], 1, 4) == c.standard["std_group"]) & (borrowed["heading"] == c.standard["std_heading"]), "left_anti")
    own = c.declared().select(F.col("file").alias("of"), "dict_heading", "dict_group")
    lost = lost.join(own, (lost["file"] == own["of"]) & (lost["heading"] == own["dict_heading"]), "left_anti")
    here = c.used().select(F.col("file").alias("f"), F.col("group").alias("g"), F.col("heading").alias("h"))
    lost = lost.join(here, (lost["file"] == here["f"]) & (F.substring(lost["heading"], 1, 4) == here["g"]) & (lost["heading"] == here["h"]), "left_anti")
    std = lost.join(F.broadcast(c.standard.select(F.col("std_group").alias("sg"), F.col("std_heading").alias("sh"))), (lost["group"] == F.col("sg")) & (lost["heading"] == F.col("sh")), "left_anti")
    name = F.col("heading")
    return [
        found(groups, "19", "group name is not four capitals"), found(long, "19a", F.concat(name, F.lit(" has over nine characters"))), found(odd, "19a", F.concat(name, F.lit(" has other than capitals, digits and _"))),
        found(shape, "19b", F.concat(name, F.lit(" is not GGGG_ and up to four characters"))), found(std, "19b", F.concat(name, F.lit(" is not defined in the group that it names"))),
    ]


@rule("20")
def file_sets(c: Check) -> list[DataFrame]:
    sets = c.cells().where("heading = 'FILE_FSET' and `group` <> 'FILE'").select("file", "group", "line", F.trim("value").alias("value"))
    out = [_undefined(c, sets, "FILE", "FILE_FSET", "20", "file set")]
    if c.files_root is not None:
        root = c.files_root
        there = c.rows("FILE").select("file", "group", "line", F.trim(c.cell("FILE_FSET")).alias("s"), F.trim(c.cell("FILE_NAME")).alias("n"))

        @F.pandas_udf("boolean")
        def exists(s: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([os.path.exists(os.path.join(root, str(a), str(b))) for a, b in zip(s, n)], dtype=bool)

        out.append(found(there.where(~exists("s", "n")), "20", F.concat(F.lit("no file "), F.col("s"), F.lit("/"), F.col("n"))))
    return out


def validate(records: DataFrame, dictionary: Dictionary, edition: str = "", files_root: str | None = None, severities: tuple[str, ...] = ("error", "warning", "fyi")) -> DataFrame:
    """All findings of all files. Cache ``records`` first: every rule reads them. (Rule 12 has no check.)"""
    c = Check(records, dictionary, edition, files_root)
    out = records.sparkSession.createDataFrame([], FINDING)
    for f in dict.fromkeys(RULES.values()):
        for part in f(c):
            out = out.unionByName(part)
    return out.where(F.col("severity").isin(*severities))


#: Headings that 4.0.4 has and 4.0.3 has not.
NEW_IN_4_0_4 = (
    ("GCHM", "GCHM_DLM"), ("GCHM", "GCHM_RTXT"), ("LOCA", "LOCA_NATD"), ("LOCA", "LOCA_ORCO"), ("LOCA", "LOCA_ORID"), ("LOCA", "LOCA_ORJO"),
    ("RDEN", "RDEN_IDEN"), ("SAMP", "SAMP_RECL"),
)


def guarded_edition(edition: str, headings: Mapping[str, Sequence[str]], forced: bool = False) -> tuple[str, str | None]:
    """(edition, the heading that shows it): a file of 4.0.3 by its own word that uses a later heading is of 4.0.4, unless forced."""
    if edition != "4.0.3" or forced:
        return edition, None
    shown = next((h for g, h in NEW_IN_4_0_4 if h in headings.get(g, ())), None)
    return ("4.0.4", shown) if shown else (edition, None)


def resolve_edition(declared: str | None, known: tuple[str, ...] = EDITIONS, forced: str | None = None) -> str:
    """Forced, else exact, else the newest patch of the same minor, else 4.1.1; a bare 4 is 4.0.4; 3.x is refused."""
    wanted = (forced or declared or "").strip()
    if wanted.startswith("3"):
        raise lexer.DeliveryError("UnsupportedEdition", wanted)
    if wanted in known:
        return wanted
    if wanted == "4":
        return "4.0.4"
    same = sorted(k for k in known if k.split(".")[:2] == wanted.split(".")[:2])
    return same[-1] if same else "4.1.1"
