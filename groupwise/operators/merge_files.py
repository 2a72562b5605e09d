"""Diff and merge of whole deliveries: every group of several files, by their dictionaries' keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..sources.delivery import Delivery
from ..sources.dictionary import Dictionary
from ..sources.lexer import DeliveryError
from . import revise
from .emit import Block

CLASHES = ("error", "widen", "promote")
#: Without a transmission of its own, a merged file keeps those of all files, or is refused.
MISSING_TRAN = ("reconcile", "error")
#: Groups first in a merged file.
FIRST = ("PROJ", "TRAN")


def diff(a: Delivery, b: Delivery, dictionary: Dictionary) -> tuple[list[str], list[str], dict[str, DataFrame]]:
    """Groups added, groups removed, and (key, kind, cells) of each common group."""
    both = {}
    for g in a.groups:
        if g in b.groups:
            types = {h: t for h, t in zip(a.shapes[g].headings, a.shapes[g].types)}
            typed = {h: (lambda c, t=t: values.parse(c, t)) for h, t in types.items()}
            left, right = a.raw(g).drop("file", "line"), b.raw(g).drop("file", "line")
            keys = [k for k in dictionary.key_chain(g) or [] if k in left.columns and k in right.columns]
            keys = keys or [h for h in a.shapes[g].headings if h in right.columns]
            both[g] = revise.diff_rows(left.select(*a.shapes[g].headings, "data_row"), right.select(*b.shapes[g].headings, "data_row"), keys, ["data_row"], typed).withColumn("cells", F.filter("cells", lambda c: c["heading"] != "data_row")).where("kind <> 'changed' or size(cells) > 0")
    return [g for g in b.groups if g not in a.groups], [g for g in a.groups if g not in b.groups], both


def merged_type(types: Sequence[str], clash: str) -> str:
    """One type for a heading: equal ones stay; else X (widen), the most decimals (promote) or an error."""
    found = list(dict.fromkeys(t.upper() for t in types if t))
    if len(found) <= 1:
        return found[0] if found else "X"
    decimals = [values.decimal_places(t) for t in found]
    if clash == "promote" and all(d is not None for d in decimals):
        return f"{max(decimals)}DP"
    if clash == "widen":
        return "X"
    raise DeliveryError("TypeClash", " / ".join(found))


def merged_unit(units: Sequence[str], heading: str) -> str:
    """One unit for a heading; blanks have no opinion, different ones never mix."""
    found = list(dict.fromkeys(u for u in units if u))
    if len(found) > 1:
        raise DeliveryError("UnitClash", f"{heading}: {' / '.join(found)}")
    return found[0] if found else ""


def _warning(kind: str, group: str, heading: str | None, message: str) -> dict[str, str | None]:
    return {"kind": kind, "group": group, "heading": heading, "message": message}


def recency_warnings(files: Sequence[Delivery]) -> list[dict[str, str | None]]:
    """Files whose TRAN_DATE is of an earlier day than that of a file before them; the order given still wins."""
    out, latest = [], None
    for i, f in enumerate(files):
        if "TRAN" not in f.groups or "TRAN_DATE" not in f.shapes["TRAN"].headings:
            continue
        day = f.raw("TRAN").orderBy("data_row").limit(1).select(F.to_date(values.parse(F.col("TRAN_DATE"), "DT")).alias("day")).first()
        if day is None or day["day"] is None:
            continue
        if latest and day["day"] < latest[1]:
            out.append(_warning("recency_contradiction", "TRAN", "TRAN_DATE", f"file {i} ({day['day']}) is later in order but predates file {latest[0]} ({latest[1]}); the order still wins"))
        if not latest or day["day"] > latest[1]:
            latest = (i, day["day"])
    return out


def merge(files: Sequence[Delivery], dictionary: Dictionary, clash: str = "error", missing_tran: str = "reconcile", warnings: list[dict[str, str | None]] | None = None) -> list[Block]:
    """The union of all files: later cells win where their file carries the heading, rows in order of first sight.

    TRAN is merged as any other group, so that each file's transmission stays unless another
    has its key; Rule 14 allows one row only, hence a warning, or with ``missing_tran``
    "error" a refusal. ``warnings`` takes (kind, group, heading, message) of what was resolved.
    """
    notes = recency_warnings(files) if warnings is not None else []
    if any("TRAN" in f.groups for f in files):
        if missing_tran == "error":
            raise DeliveryError("MissingTran", "the merged file has no transmission of its own, and those of its files are more than Rule 14 allows")
        notes.append(_warning("tran_not_stamped", "TRAN", None, "TRAN was merged as any other group; more than one row fails Rule 14"))
    order = [g for g in FIRST if any(g in f.groups for f in files)] + sorted({g for f in files for g in f.groups} - set(FIRST))
    out = []
    for g in order:
        have = [f for f in files if g in f.groups]
        headings = list(dict.fromkeys(h for f in have for h in f.shapes[g].headings))
        per = lambda what, h: [getattr(f.shapes[g], what)[f.shapes[g].headings.index(h)] for f in have if h in f.shapes[g].headings]  # noqa: E731,B023
        types, units = [merged_type(per("types", h), clash) for h in headings], [merged_unit(per("units", h), h) for h in headings]
        for h, t in zip(headings, types):
            found = sorted({x.upper() for x in per("types", h) if x})
            if len(found) > 1 and t != "X":
                notes.append(_warning("type_promoted", g, h, f"types {' / '.join(found)} promoted to {t}, values padded with zeros"))
            elif len([x for x in found if x != "X"]) > 1:
                notes.append(_warning("type_widened", g, h, f"types {' / '.join(found)} widened to X, values kept as text"))
        # a blank cell that a file carries is a value, so that it overwrites
        versions = []
        for f in have:
            raw = f.raw(g)
            cells = {h: F.coalesce(F.col(h), F.lit("")) for h in f.shapes[g].headings}
            for h, t in zip(headings, types):
                if h in cells and clash == "promote" and values.decimal_places(t):
                    cells[h] = values.pad_decimals(cells[h], values.decimal_places(t))
            versions.append(raw.select("data_row", *[c.alias(h) for h, c in cells.items()]))
        chain = [k for k in dictionary.key_chain(g) or [] if k in headings]
        keys = chain or headings  # rows without keys collapse when they are identical
        filled = [v.select("data_row", *[F.col(h) if h in v.columns else F.lit("").alias(h) for h in keys], *[h for h in v.columns if h not in keys and h != "data_row"]) for v in versions]
        made = revise.merge(filled, keys, ["data_row"]).drop("data_row")
        out.append(Block(g, made, [h for h in headings if h in made.columns], [u for h, u in zip(headings, units) if h in made.columns], [t for h, t in zip(headings, types) if h in made.columns], ["first_seen"]))
    if warnings is not None:
        warnings += notes
    return out
