"""Deliveries of grouped text as DataFrames.

One file is one task (quotes span lines), many files are many tasks. ``scan`` gives every
record of every file as a row. A group is typed by its HEADING, UNIT and TYPE records; the
different ones of all files are few and read on the driver. Where all files and sections
have a group's headings in one order, its cells are columns over an array by place; where
they differ, each row meets the headings of its own section and cells are found by name.
Either way unused cells, ids included, are pruned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import keys, values
from . import lexer
from .dictionary import Dictionary

ROWS = "file string, rec int, line int, terminator string, byte_offset long, text string, tag string, `group` string, section int, data_row int, values array<string>"


def _tuples(file: str, raw: bytes, encoding: str, errors: str) -> list[tuple]:
    text, bom = lexer.decode(raw, encoding, errors)
    out, at, done = [], 3 if bom else 0, 0
    for r in lexer.rows(text):
        at += len(text[done : r.record.offset].encode(encoding, "replace"))
        done = r.record.offset
        out.append((file, r.record.rec, r.record.line, r.record.terminator, at, r.record.text, r.tag, r.group, r.section, r.data_row, r.values))
    return out


def _rows_of(file: str, raw: bytes, encoding: str, errors: str) -> pd.DataFrame:
    names = [c.strip(" `").split(" ")[0].strip("`") for c in ROWS.split(",")]
    return pd.DataFrame(_tuples(file, raw, encoding, errors), columns=names).astype({"data_row": "Int32"})


def _refused(file: str, why: lexer.DeliveryError) -> pd.DataFrame:
    """The one row of a file that can't be read: tag ERROR, its values the kind and the message."""
    names = [c.strip(" `").split(" ")[0].strip("`") for c in ROWS.split(",")]
    row = dict.fromkeys(names) | {"file": file, "rec": 0, "line": 0, "byte_offset": 0, "section": 0, "text": "", "terminator": "", "tag": "ERROR", "values": [why.kind, str(why)]}
    return pd.DataFrame([row], columns=names).astype({"data_row": "Int32"})


def scan(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", errors: str = "strict", glob: str | None = None, check: bool = False) -> DataFrame:
    """Every record that isn't blank of the files under ``path``; with ``check``, an ERROR row for each file that can't be read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return scan_contents(reader.load(path if isinstance(path, str) else list(path)).select("path", "content"), encoding, errors, check)


def scan_contents(files: DataFrame, encoding: str = "utf-8", errors: str = "strict", check: bool = False) -> DataFrame:
    """``scan`` of files given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                try:
                    if check:
                        lexer.check_readable(lexer.decode(bytes(raw), encoding, errors)[0])
                    yield _rows_of(file, bytes(raw), encoding, errors)
                except lexer.DeliveryError as e:
                    if not check:
                        raise
                    yield _refused(file, e)

    return files.select("path", "content").mapInPandas(run, ROWS)


def scan_text(spark: SparkSession, text: str, file: str = "inline") -> DataFrame:
    return spark.createDataFrame(_tuples(file, text.encode(), "utf-8", "strict"), ROWS)


@dataclass
class Shape:
    """A group's descriptor rows."""

    headings: list[str]
    units: list[str]
    types: list[str]


def _padded(found: list[str], n: int, fill: str) -> list[str]:
    return [x.strip() for x in found[:n]] + [fill] * (n - len(found))


def sections(rows: DataFrame) -> DataFrame:
    """(file, group, section, shape): the descriptor records of every section, or of the group's last one before in its file.

    ``shape`` is (headings, units, types); a heading that repeats is named name__2, name__3, ...
    """
    told = rows.where(F.col("tag").isin("HEADING", "UNIT", "TYPE", "DATA") & F.col("group").isNotNull())
    first = lambda tag: F.expr(f"min_by(values, rec) filter (where tag = '{tag}')")
    found = told.groupBy("file", "group", "section").agg(*(first(t).alias(t) for t in ("HEADING", "UNIT", "TYPE")))
    names = F.transform("HEADING", F.trim)
    turn = lambda x, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda y: y == x))
    named = F.transform(names, lambda x, i: F.when(turn(x, i) > 1, F.concat(x, F.lit("__"), turn(x, i).cast("string"))).otherwise(x))
    shape = F.when(F.col("HEADING").isNotNull(), F.struct(named.alias("headings"), F.coalesce("UNIT", F.array()).alias("units"), F.coalesce("TYPE", F.array()).alias("types")))
    so_far = Window.partitionBy("file", "group").orderBy("section")
    return found.withColumn("shape", F.last(shape, ignorenulls=True).over(so_far)).select("file", "group", "section", "shape")


def _one_type(types: list[str], on_clash: str, of: str) -> str:
    """One type for cells of several sections: equal ones stay, numbers meet in the one with most decimals, others in text."""
    if len(types) == 1:
        return types[0]
    if on_clash == "error":
        raise lexer.DeliveryError("TypeClash", f"{of}: {' / '.join(types)}")
    places = [values.decimal_places(t) for t in types]
    return f"{max(places)}DP" if None not in places else "X"


def shapes(found: list, on_duplicate: str = "error", on_clash: str = "widen") -> dict[str, Shape]:
    """Shape of each group from rows (group, shape, ..) of its sections in order of sight: headings of all of them, each with its unit and type.

    on_duplicate: error or recover; on_clash of types: widen or error. Different units never mix.
    """
    seen: dict[str, dict[str, tuple[list[str], list[str]]]] = {}
    for r in found:
        group, shape = r["group"], r["shape"]
        heads = seen.setdefault(group, {})
        if shape is None:
            continue
        n = len(shape["headings"])
        units, types = _padded(shape["units"], n, ""), [t or "X" for t in _padded(shape["types"], n, "X")]
        for h, u, t in zip(shape["headings"], units, types):
            if on_duplicate == "error" and re.search(r"__[0-9]+$", h) and h.rsplit("__", 1)[0] in shape["headings"]:
                raise lexer.DeliveryError("Structure", f"{group} has heading {h.rsplit('__', 1)[0]} twice")
            of = heads.setdefault(h, ([], []))
            if u and u not in of[0]:
                of[0].append(u)
            if t.upper() not in [x.upper() for x in of[1]]:
                of[1].append(t)
    out = {}
    for group, heads in seen.items():
        for h, (units, _) in heads.items():
            if len(units) > 1:
                raise lexer.DeliveryError("UnitClash", f"{group}.{h}: {' / '.join(units)}")
        out[group] = Shape(list(heads), [u[0] if u else "" for u, _ in heads.values()], [_one_type(t, on_clash, f"{group}.{h}") for h, (_, t) in heads.items()])
    return out


class Delivery:
    """One or several files, read as typed groups.

    Known groups carry ``_id`` and ``_parent_id``; ``_content_hash`` is there if asked for.
    """

    def __init__(
        self, rows: DataFrame, dictionary: Dictionary | None = None, on_duplicate: str = "error", on_excess: str = "error",
        content_hash: bool = False, xn_numeric: bool = False, on_clash: str = "widen", own_dict: bool = True,
    ):
        self.rows = rows.cache()
        self.spark = rows.sparkSession
        for bad in self.rows.where("tag = 'ERROR'").select("file", "values").limit(1).collect():
            self.rows.unpersist()
            raise lexer.DeliveryError(bad["values"][0], f"{bad['file']}: {bad['values'][1]}")
        self.sections = sections(self.rows)
        found = self.sections.groupBy("group", "shape").agg(F.min(F.struct("file", "section")).alias("at")).collect()
        found.sort(key=lambda r: r["at"])
        self.shapes = shapes(found, on_duplicate, on_clash)
        self.orders: dict[str, set[tuple[str, ...]]] = {}
        for r in found:
            self.orders.setdefault(r["group"], set()).add(tuple(r["shape"]["headings"]) if r["shape"] else ())
        self.dictionary = dictionary or Dictionary.empty()
        self.on_excess, self.content_hash, self.xn_numeric = on_excess, content_hash, xn_numeric
        if own_dict and "DICT" in self.shapes:
            self.dictionary = self.dictionary.layered(self._own_dictionary())

    def _own_dictionary(self) -> Dictionary:
        """Groups and headings that the files' own DICT groups declare, the first declaration of each."""
        rows = self.raw("DICT")
        names = [h for h in self.shapes["DICT"].headings if h.startswith("DICT_")]
        if not {"DICT_GRP", "DICT_HDNG"} <= set(names):
            return Dictionary.empty()
        kind = F.col("DICT_TYPE") if "DICT_TYPE" in names else F.lit("")
        once = rows.groupBy(*(F.trim(F.coalesce(c, F.lit(""))).alias(k) for c, k in ((kind, "k"), (F.col("DICT_GRP"), "g"), (F.col("DICT_HDNG"), "h"))))
        first = once.agg(F.min_by(F.struct(*names), F.struct("file", "data_row")).alias("row"), F.min(F.struct("file", "data_row")).alias("at"))
        out = Dictionary.empty()
        for r in sorted(first.collect(), key=lambda r: r["at"]):
            out._add("DICT", {c: (r["row"][c] or "").strip() for c in names})
        return out

    def close(self) -> None:
        """Free the cached records."""
        self.rows.unpersist()

    @property
    def groups(self) -> list[str]:
        return list(self.shapes)

    def raw(self, group: str) -> DataFrame:
        """The group's DATA rows: file, line, data_row and raw cells by heading, null past a short row's end."""
        shape = self._shape(group)
        data = self.rows.where((F.col("group") == group) & (F.col("tag") == "DATA"))
        alike = len(self.orders[group]) == 1
        if not alike:
            own = self.sections.where(F.col("group") == group).select("file", "section", F.coalesce("shape.headings", F.array().cast("array<string>")).alias("heads"))
            data = data.join(own, ["file", "section"])
        if self.on_excess == "error":
            most = F.lit(len(shape.headings)) if alike else F.size("heads")
            wrong = F.raise_error(F.concat(F.lit(f"Structure: {group} line "), F.col("line").cast("string"), F.lit(" has too many fields")))
            data = data.withColumn("values", F.when(F.size("values") <= most, F.col("values")).otherwise(wrong))
        at = lambda i, h: F.lit(i) if alike else F.array_position("heads", F.lit(h)).cast("int") - 1
        return data.select("file", "line", "data_row", *(F.get("values", at(i, h)).alias(h) for i, h in enumerate(shape.headings)))

    def _shape(self, group: str) -> Shape:
        if group not in self.shapes:
            raise KeyError(f"no group {group}")
        return self.shapes[group]

    def _ids(self, group: str, cell: dict[str, Column]) -> list[Column]:
        chain = self.dictionary.key_chain(group)
        if chain is None:
            return []
        out = [keys.content_id(group, [(k, cell.get(k)) for k in chain]).alias("_id")]
        parent = self.dictionary.parent(group)
        above = self.dictionary.key_chain(parent) if parent else None
        parent_id = keys.content_id(parent, [(k, cell.get(k)) for k in above]) if above is not None else F.lit(None).cast("string")
        return [*out, parent_id.alias("_parent_id")]

    def table(self, group: str, keys_too: bool = False, source: bool = False) -> DataFrame:
        """The typed group; ids, and the ``file`` of each row, are left out unless asked for."""
        shape, raw = self._shape(group), self.raw(group)
        cell = {h: F.col(f"`{h}`") for h in shape.headings}
        typed = [values.parse(cell[h], t, u, self.xn_numeric).alias(h, metadata={"unit": u, "type": t}) for h, u, t in zip(shape.headings, shape.units, shape.types)]
        out = (["file"] if source else []) + (self._ids(group, cell) if keys_too else [])
        if self.content_hash:
            out.append(keys.content_hash(group, [(h, u, values.canonical_text(cell[h], t)) for h, u, t in zip(shape.headings, shape.units, shape.types)]).alias("_content_hash"))
        return raw.select(*out, *typed)

    __getitem__ = table

    def strings(self, group: str) -> DataFrame:
        """UNIT, TYPE and DATA rows as text, HEADING first, in order of ``_at``."""
        shape = self._shape(group)
        names = ["HEADING", *shape.headings, "_at"]
        top = self.spark.createDataFrame([("UNIT", *shape.units, -2), ("TYPE", *shape.types, -1)], ", ".join(f"`{n}` {'bigint' if n == '_at' else 'string'}" for n in names))
        data = self.raw(group).select(F.lit("DATA").alias("HEADING"), *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in shape.headings], F.col("data_row").cast("bigint").alias("_at"))
        return top.unionByName(data)

    def register(self, prefix: str = "") -> None:
        """Temporary views of every group, ids included, for spark.sql."""
        for g in self.groups:
            self.table(g, keys_too=True).createOrReplaceTempView(f"{prefix}{g}")

    def sql(self, text: str) -> DataFrame:
        self.register()
        return self.spark.sql(text)

    def group_catalog(self) -> DataFrame:
        """(group, n_rows, n_headings)."""
        n = {g: len(s.headings) for g, s in self.shapes.items()}
        size = self.spark.createDataFrame(list(n.items()) or [(None, None)], "`group` string, n_headings int").where("`group` is not null")
        counts = self.rows.where("tag = 'DATA'").groupBy(F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias("n_rows"))
        return size.join(counts, size["group"] == counts["_g"], "left").select("group", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_headings")

    def heading_catalog(self) -> DataFrame:
        """(group, heading, unit, ags_type, sql_type, is_key, ordinal)."""
        rows = []
        for g, s in self.shapes.items():
            own = set(self.dictionary.own_keys(g))
            rows += [(g, h, u, t, values.sql_type(t, u), h in own, i) for i, (h, u, t) in enumerate(zip(s.headings, s.units, s.types), 1)]
        return self.spark.createDataFrame(rows, "`group` string, heading string, unit string, ags_type string, sql_type string, is_key boolean, ordinal int")

    def text(self) -> str:
        """The retained text of a single file, byte for byte but for blank records' white space."""
        rows = self.rows.select("text", "terminator").orderBy("rec").toLocalIterator()
        return "".join(r["text"] + r["terminator"] for r in rows)

    def store(self, path: str, groups: Sequence[str] | None = None) -> None:
        """One Parquet table for each group under ``path``; existing ones are an error."""
        for g in groups or self.groups:
            self.table(g, keys_too=True).write.mode("errorifexists").parquet(f"{path}/{g}")

    def ddl(self, path: str) -> list[tuple[int, str]]:
        """(order, statement) that make tables of a stored delivery."""
        return [(i, f"CREATE TABLE ags_{g.lower()} USING parquet LOCATION '{path}/{g}'") for i, g in enumerate(self.groups, 1)]


def read(spark: SparkSession, path: str | Sequence[str], **options) -> Delivery:
    """Strict read; options of ``scan`` and ``Delivery``. A file that can't be read is a ``DeliveryError``."""
    of_scan = {k: options.pop(k) for k in ("encoding", "errors", "glob") if k in options}
    return Delivery(scan(spark, path, check=True, **of_scan), **options)


def read_text(spark: SparkSession, text: str, **options) -> Delivery:
    lexer.check_readable(text)
    return Delivery(scan_text(spark, text), **options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """A group's raw cells; one partition for each file, sections of other groups are not cut into fields."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.group = options["path"], options["group"]
        self.encoding, self.columns = options.get("encoding", "utf-8"), columns

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            raw = f.read()
        for code, first, end in lexer.byte_index(raw, self.encoding):
            if code == self.group:
                text, _ = lexer.decode(raw[first:end], self.encoding)
                for r in lexer.rows(text):
                    if r.tag == "DATA":
                        yield tuple(r.values[i] if i < len(r.values) else None for i in range(len(self.columns)))


class GroupSource(DataSource):
    """``spark.read.format("grouped").option("group", ...).load(path)``: one group of local files as text columns."""

    @classmethod
    def name(cls) -> str:
        return "grouped"

    def schema(self) -> str:
        import glob

        for p in sorted(glob.glob(self.options["path"])):
            with open(p, "rb") as f:
                raw = f.read()
            for code, first, end in lexer.byte_index(raw, self.options.get("encoding", "utf-8")):
                if code == self.options["group"]:
                    for r in lexer.rows(lexer.decode(raw[first:end], self.options.get("encoding", "utf-8"))[0]):
                        if r.tag == "HEADING":
                            return ", ".join(f"`{h.strip()}` string" for h in r.values)
        raise lexer.DeliveryError("Structure", f"no group {self.options['group']}")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema.names)


def ags_crawl(spark: SparkSession, path: str, glob: str = "*.ags") -> DataFrame:
    """(file, size, kind) of the files under a directory: grouped, old_edition or other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = []
            for raw in pdf["content"]:
                try:
                    lexer.check_readable(lexer.decode(bytes(raw), errors="replace")[0])
                    kinds.append("grouped")
                except lexer.DeliveryError as e:
                    kinds.append("old_edition" if e.kind == "UnsupportedEdition" else "other")
            yield pd.DataFrame({"file": pdf["path"], "size": pdf["length"], "kind": kinds})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content").mapInPandas(run, "file string, size long, kind string")
