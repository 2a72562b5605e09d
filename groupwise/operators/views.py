"""Whole deliveries as they are used: selections that add up, rows attached to their parents, edits, text tables, Arrow, chart series."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, values
from ..sources.delivery import Delivery
from ..sources.dictionary import Dictionary
from . import analytics, emit
from .relational import IN_LIMIT

#: Fixed value: the parent of groups that no dictionary has, where they carry its key.
ADOPTS = "LOCA"
#: Groups first in dictionary order.
HEADERS = ("PROJ", "ABBR", "DICT", "FILE", "TRAN", "TYPE", "UNIT")
#: Groups first in hierarchical order; all that descends from the first one follows.
SEEDS = ("PROJ", "TRAN", "ABBR", "DICT", "FILE", "TYPE", "UNIT", "LBSG", "LBST", "PREM", "STND")


@dataclass(frozen=True)
class Selection:
    """A delivery narrowed by any number of ``at``; nothing is read before a table is asked for."""

    delivery: Delivery
    filters: tuple[tuple[str, str | None, tuple], ...] = ()

    def at(self, group: str, wanted: Sequence, by: str | None = None) -> Selection:
        """Rows whose {group}_ID is among the values, in every group that has it; others pass whole.

        ``by`` "_id" takes the group's own rows by id and those of its direct children by
        parent id. An error where no group is reached; None among the values is dropped with a
        warning, and no values leave no rows.
        """
        if by not in (None, "_id"):
            raise ValueError(f"rows are found by {group}_ID or by _id, not by {by}")
        kept = tuple(v for v in wanted if v is not None)
        if len(kept) < len(wanted):
            warnings.warn(f"a null never matches {group}", stacklevel=2)
        out = replace(self, filters=(*self.filters, (group, by, kept)))
        if not any(out._key(code, group, by) for code in self.delivery.groups):
            raise ValueError(f"no group has rows of {group}")
        return out

    def _key(self, code: str, group: str, by: str | None) -> str | None:
        if by is None:
            return f"{group}_ID" if f"{group}_ID" in self.delivery.shapes[code].headings else None
        if code == group:
            return "_id"
        return "_parent_id" if parent_of(self.delivery, code) == group else None

    def table(self, code: str) -> DataFrame:
        """The typed group, ids first, under all filters."""
        out = with_ids(self.delivery, code)
        for group, by, wanted in self.filters:
            key = self._key(code, group, by)
            if key is None:
                continue
            if not wanted:
                out = out.where(F.lit(False))
            elif len(wanted) <= IN_LIMIT:
                out = out.where(F.col(f"`{key}`").cast("string").isin([str(v) for v in wanted]))
            else:
                names = self.delivery.spark.createDataFrame([(str(v),) for v in wanted], "_at string")
                out = out.join(names, F.col(f"`{key}`").cast("string") == F.col("_at"), "left_semi")
        return out

    __getitem__ = table

    def frames(self) -> dict[str, DataFrame]:
        return {g: self.table(g) for g in self.delivery.groups}


def parent_of(d: Delivery, group: str) -> str | None:
    """The group's parent; one that no dictionary has belongs to ADOPTS where it carries that key."""
    if group in d.dictionary.groups:
        return d.dictionary.parent(group)
    return ADOPTS if group != ADOPTS and f"{ADOPTS}_ID" in d.shapes[group].headings and d.dictionary.key_chain(ADOPTS) else None


def with_ids(d: Delivery, group: str) -> DataFrame:
    """The typed group with ``_id`` and ``_parent_id``, null where no dictionary gives it keys or a parent."""
    typed = d.table(group, keys_too=True)
    if "_id" in typed.columns:
        return typed
    parent = parent_of(d, group)
    chain = d.dictionary.key_chain(parent) if parent else None
    here = d.shapes[group].headings
    above = keys.content_id(parent, [(k, F.col(f"`{k}`").cast("string") if k in here else F.lit(None)) for k in chain]) if chain else F.lit(None).cast("string")
    return typed.select(F.lit(None).cast("string").alias("_id"), above.alias("_parent_id"), *(f"`{c}`" for c in typed.columns))


def attached(d: Delivery) -> dict[str, DataFrame]:
    """The delivery as a graph in tables: of each group its different rows that hang, link by link, on a row of a group without a parent.

    Rows without a parent row, and what hangs on these, are left out; a parent group that isn't in
    the delivery holds nothing. A group with none of its parent's keys hangs on the parent as a whole.
    """
    out: dict[str, DataFrame] = {}
    depth = {g: d.dictionary.depth(g) if g in d.dictionary.groups else d.dictionary.depth(ADOPTS) + 1 for g in d.groups}
    for g in sorted(d.groups, key=lambda g: (depth[g], d.groups.index(g))):
        rows, parent = with_ids(d, g).dropDuplicates(), parent_of(d, g)
        if parent is not None:
            if parent not in out or not shares_keys(d, g, parent) and out[parent].isEmpty():
                rows = rows.where(F.lit(False))
            elif shares_keys(d, g, parent):
                rows = rows.join(out[parent].select(F.col("_id").alias("_up")), F.col("_parent_id") == F.col("_up"), "left_semi")
        out[g] = rows
    return {g: out[g] for g in d.groups}


def shares_keys(d: Delivery, group: str, parent: str) -> bool:
    """Whether the group's files carry any key of the parent."""
    return bool(set(d.dictionary.key_chain(parent) or ()) & set(d.shapes[group].headings))


def record(graph: Mapping[str, DataFrame], d: Delivery, group: str, row_id: str) -> dict | None:
    """One row of ``attached`` with all that hangs on it, nested by group; only these rows come to the driver."""
    row = graph[group].where(F.col("_id") == row_id).first()
    if row is None:
        return None
    out = {c: v for c, v in row.asDict().items() if not c.startswith("_")}
    for g in graph:
        if parent_of(d, g) == group:
            found = graph[g].where(F.col("_parent_id") == row_id if shares_keys(d, g, group) else F.lit(True)).collect()
            out[g] = [record(graph, d, g, r["_id"]) if r["_id"] else {c: v for c, v in r.asDict().items() if not c.startswith("_")} for r in found]
    return out


def group_order(groups: Sequence[str], dictionary: Dictionary, strategy: str = "dictionary") -> list[str]:
    """Groups in dictionary order (HEADERS, then by name), alphabetical, or hierarchical (SEEDS, then parents before children, depth first).

    Groups that the order has no place for come last by name, with a warning.
    """
    if strategy == "alphabetical":
        return sorted(groups)
    if strategy == "dictionary":
        order = [*HEADERS, *sorted(set(dictionary.groups) - set(HEADERS))]
    elif strategy == "hierarchical":
        order, below = list(SEEDS), [SEEDS[0]]
        children: dict[str | None, list[str]] = {}
        for g, parent in dictionary.groups.items():
            children.setdefault(parent, []).append(g)
        while below:
            g = below.pop()
            if g not in order:
                order.append(g)
            below += [c for c in reversed(children.get(g, [])) if c not in order]
    else:
        raise ValueError(f"no strategy {strategy}")
    last = sorted(set(groups) - set(order))
    if last:
        warnings.warn(f"not in the dictionary: {', '.join(last)}", stacklevel=2)
    return [g for g in order if g in groups] + last


def probe_depth(group: str, columns: Sequence[str], dictionary: Dictionary) -> tuple[str, str] | None:
    """(column, level) of the one depth that a row is looked up by: its specimen's, its sample's, or its own top."""
    for name, level in (("SPEC_DPTH", "specimen"), ("SAMP_TOP", "sample")):
        if name in columns:
            return name, level
    own = (h.name for h in dictionary.headings.get(group, []) if h.name.endswith("_TOP") and h.type == "2DP")
    return next(((n, "self") for n in own if n in columns), None)


# -- edits ----------------------------------------------------------------------------------


def blocks(d: Delivery) -> list[emit.Block]:
    """The delivery's groups as blocks to edit and write."""
    return [emit.Block(g, d.raw(g), s.headings, s.units, s.types, ["file", "data_row"]) for g, s in d.shapes.items()]


def set_cell(block: emit.Block, heading: str, value: str, where: Column) -> emit.Block:
    """The block with a cell of the rows ``where`` set."""
    if heading not in block.headings:
        raise KeyError(f"{block.group} has no heading {heading}")
    c = F.col(f"`{heading}`")
    return replace(block, frame=block.frame.withColumn(heading, F.when(where, F.lit(value)).otherwise(c)))


def push_row(block: emit.Block, cells: Mapping[str, str]) -> emit.Block:
    """The block with a row after all others; headings that aren't named stay blank."""
    if unknown := set(cells) - set(block.headings):
        raise KeyError(f"{block.group} has no heading {min(unknown)}")
    spark = block.frame.sparkSession
    at = "_pushed"
    frame = block.frame if at in block.frame.columns else block.frame.withColumn(at, F.lit(0))
    last = frame.agg(F.max(at)).first()[0] or 0
    new = spark.createDataFrame([(*(cells.get(h, "") for h in block.headings), last + 1)], ", ".join([*(f"`{h}` string" for h in block.headings), f"{at} int"]))
    order = block.order if block.order[:1] == [at] else [at, *block.order]
    return replace(block, frame=frame.unionByName(new, allowMissingColumns=True), order=order)


def remove_group(found: Sequence[emit.Block], group: str) -> list[emit.Block]:
    if all(b.group != group for b in found):
        raise KeyError(f"no group {group}")
    return [b for b in found if b.group != group]


# -- text tables ----------------------------------------------------------------------------


def text_tables(d: Delivery) -> dict[str, DataFrame]:
    """Every group as text: UNIT, TYPE and DATA rows under the column HEADING, in order of ``_at``."""
    return {g: d.strings(g) for g in d.groups}


def numeric(table: DataFrame) -> DataFrame:
    """DATA rows of a text table, numbers under a numeric type as double; what isn't a number is null."""
    types = table.where("HEADING = 'TYPE'").first()
    if types is None:
        raise ValueError("a text table has a TYPE row")
    cells = [values.parse_decimal(F.col(f"`{c}`")).alias(c) if values.formatter(types[c] or "X") else F.col(f"`{c}`") for c in table.columns if c not in ("HEADING", "_at")]
    return table.where("HEADING = 'DATA'").select(*cells)


def texts(frame: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A typed frame as text, each column under its type; null is blank."""
    made = [F.coalesce(emit.cell_text(F.col(f"`{c}`"), types.get(c, "X")), F.lit("")).alias(c) for c in frame.columns]
    return frame.select(*made)


def errors_by_rule(findings: DataFrame, most: int = 1000) -> dict[str, list[dict]]:
    """{rule: its findings in order}, ``most`` of each; ``total`` in each tells how many there are."""
    out: dict[str, list[dict]] = {}
    for r in analytics.capped(findings, most, ["file", "line", "desc"]).orderBy("rule", "file", "line", "desc").collect():
        out.setdefault(r["rule"], []).append({k: r[k] for k in ("file", "line", "group", "desc", "severity", "total")})
    return out


def declared_edition(d: Delivery) -> str | None:
    """TRAN_AGS of the first transmission."""
    if "TRAN" not in d.groups or "TRAN_AGS" not in d.shapes["TRAN"].headings:
        return None
    row = d.raw("TRAN").orderBy("file", "data_row").select(F.trim("TRAN_AGS")).first()
    return row[0] or None if row else None


def matrix_lines(rows: DataFrame, cells: str, order: Sequence[str]) -> DataFrame:
    """(text) of a table whose column ``cells`` holds whole records, tag first."""
    quoted = F.transform(cells, lambda c: values.quoted(F.coalesce(c, F.lit(""))))
    return rows.orderBy(*order).select(F.concat(F.array_join(quoted, ","), F.lit("\r\n")).alias("text"))


def diff_json(added: Sequence[str], removed: Sequence[str], both: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(group, kind, value): groups added and removed, and every changed row as JSON."""
    out = spark.createDataFrame([(g, k, None) for k, gs in (("group_added", added), ("group_removed", removed)) for g in gs], "`group` string, kind string, value string")
    for g, rows in both.items():
        out = out.unionByName(rows.select(F.lit(g).alias("group"), "kind", F.to_json(F.struct("key", "cells")).alias("value")))
    return out


# -- Arrow and charts -----------------------------------------------------------------------


def arrow(d: Delivery, group: str) -> pa.Table:
    """A group's raw cells as an Arrow table, for a group that fits the driver."""
    return d.raw(group).orderBy("file", "data_row").select(*(f"`{h}`" for h in d.shapes[group].headings)).toArrow()


def block_of_arrow(spark: SparkSession, group: str, table: pa.Table, dictionary: Dictionary, units: Mapping[str, str] | None = None, types: Mapping[str, str] | None = None) -> emit.Block:
    """A block to write from an Arrow table; times are written as precisely as their units ask."""
    at = pa.array(range(table.num_rows), pa.int64())
    frame = spark.createDataFrame(table.append_column("_at", at))
    return emit.typed_block(group, frame, dictionary, units, types, ["_at"])


def chart_series(rows: DataFrame, x: str, y: str, colour: str | None, ranked: Sequence[str], cap: int, other: str = "Other") -> DataFrame:
    """(slot, name, x, y): points by series, the first ``cap`` ranked values in slots of their own, all else pooled in slot -1.

    A null colour counts as ''; the pool's name gives way to a value of the same name.
    """
    names = list(ranked)[:cap] or [""]
    while other in names:
        other = f"{other} *"
    value = F.coalesce(F.col(colour).cast("string"), F.lit("")) if colour else F.lit("")
    slot = F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1
    return rows.select(slot.alias("slot"), F.when(slot >= 0, value).otherwise(F.lit(other)).alias("name"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
