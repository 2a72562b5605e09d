"""A SELECT composer: one description, as a DataFrame chain or as SQL text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "IS NULL", "IS NOT NULL")
_NUMERIC = re.compile(r"-?[0-9]+(\.[0-9]+)?")


@dataclass
class Condition:
    column: str
    op: str
    value: str = ""
    mode: str = "contains"  # of LIKE: contains, starts, ends or exact

    def complete(self) -> bool:
        return bool(self.column) and self.op in OPS and (self.op.startswith("IS") or self.value != "")


@dataclass
class Join:
    table: str
    keys: Sequence[tuple[str, str]]
    columns: Sequence[str]
    how: str = "inner"
    band: tuple[str, str, str] | None = None  # point column, top, base


@dataclass
class Select:
    table: str
    columns: Sequence[str] = ()
    conditions: Sequence[Condition] = ()
    order_by: str | None = None
    order_dir: str = "asc"
    limit: int | None = None
    offset: int | None = None
    joins: Sequence[Join] = field(default_factory=tuple)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def like_pattern(text: str, mode: str) -> str:
    """A LIKE pattern in which the text's own wildcards are escaped."""
    text = re.sub(r"([\\%_])", r"\\\1", text)
    return {"contains": f"%{text}%", "starts": f"{text}%", "ends": f"%{text}", "exact": text}[mode]


def _where(c: Condition, column: Column) -> Column:
    if c.op == "IS NULL":
        return column.isNull()
    if c.op == "IS NOT NULL":
        return column.isNotNull()
    if c.op == "LIKE":
        text = column.cast("string")
        return {"contains": text.contains, "starts": text.startswith, "ends": text.endswith, "exact": lambda v: text == v}[c.mode](c.value)
    value = F.lit(float(c.value)) if _NUMERIC.fullmatch(c.value) else F.lit(c.value)
    return {"=": column == value, "!=": column != value, ">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[c.op]


def result_names(tables: Sequence[tuple[str, Sequence[str]]]) -> dict[tuple[str, str], str]:
    """A name for each (table, column): plain at first sight, then with its table, then numbered."""
    used: set[str] = set()
    names = {}
    for table, columns in tables:
        for c in columns:
            name, turn = c, 2
            if name in used:
                name = f"{table}_{c}"
            while name in used:
                name, turn = f"{table}_{c}_{turn}", turn + 1
            used.add(name)
            names[table, c] = name
    return names


def frame(spec: Select, tables: Mapping[str, DataFrame], tie: Sequence[str] = ()) -> DataFrame:
    """The description as a DataFrame; incomplete conditions are dropped."""
    base = tables[spec.table].alias(spec.table)
    out = base
    shown = [(spec.table, list(spec.columns) or tables[spec.table].columns)]
    for j in spec.joins:
        other = tables[j.table].alias(j.table)
        on = reduce(lambda x, y: x & y, [F.col(f"{spec.table}.{a}").eqNullSafe(F.col(f"{j.table}.{b}")) for a, b in j.keys])
        if j.band:
            at, top, end = j.band
            on = on & (F.col(f"{spec.table}.{at}") >= F.col(f"{j.table}.{top}")) & (F.col(f"{spec.table}.{at}") < F.col(f"{j.table}.{end}"))
        out = out.join(other, on, j.how)
        shown.append((j.table, list(j.columns)))
    for c in spec.conditions:
        if c.complete():
            out = out.where(_where(c, F.col(f"{spec.table}.{c.column}")))
    names = result_names(shown)
    order = [F.col(n) for n in tie]
    if spec.order_by:
        first = F.col(f"{spec.table}.{spec.order_by}")
        order = [first.desc() if spec.order_dir == "desc" else first.asc(), *order]
    if order:
        out = out.orderBy(*order)
    if spec.offset:
        out = out.offset(spec.offset)
    if spec.limit is not None:
        out = out.limit(spec.limit)
    return out.select(*[F.col(f"{t}.{c}").alias(n) for (t, c), n in names.items()])


def sql(spec: Select) -> str:
    """The description as Spark SQL."""
    names = result_names([(spec.table, list(spec.columns)), *[(j.table, list(j.columns)) for j in spec.joins]]) if spec.columns else {}
    text = "SELECT " + (", ".join(f"{quote(t)}.{quote(c)} AS {quote(n)}" for (t, c), n in names.items()) or "*") + f" FROM {quote(spec.table)}"
    for j in spec.joins:
        on = [f"{quote(spec.table)}.{quote(a)} IS NOT DISTINCT FROM {quote(j.table)}.{quote(b)}" for a, b in j.keys]
        if j.band:
            at, top, end = (quote(x) for x in j.band)
            on += [f"{quote(spec.table)}.{at} >= {quote(j.table)}.{top}", f"{quote(spec.table)}.{at} < {quote(j.table)}.{end}"]
        text += f" {j.how.upper()} JOIN {quote(j.table)} ON {' AND '.join(on)}"
    where = []
    for c in filter(Condition.complete, spec.conditions):
        name = f"{quote(spec.table)}.{quote(c.column)}"
        literal = c.value if _NUMERIC.fullmatch(c.value) else "'" + c.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if c.op == "LIKE":
            literal = "'" + like_pattern(c.value, c.mode).replace("\\", "\\\\").replace("'", "\\'") + "'"
        where.append(f"{name} {c.op}" + ("" if c.op.startswith("IS") else f" {literal}"))
    text += f" WHERE {' AND '.join(where)}" if where else ""
    text += f" ORDER BY {quote(spec.table)}.{quote(spec.order_by)} {spec.order_dir.upper()}" if spec.order_by else ""
    text += f" LIMIT {spec.limit}" if spec.limit is not None else ""
    return text + (f" OFFSET {spec.offset}" if spec.offset else "")
