"""Dictionaries: groups, headings, keys, parents, abbreviations, from files that the caller names.

No dictionary is part of this package. A dictionary file is itself grouped text with DICT,
ABBR, TYPE and UNIT groups; a delivery's own DICT group extends it, the standard winning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import lexer


@dataclass
class Heading:
    group: str
    name: str
    status: str = "OTHER"
    type: str = "X"
    unit: str = ""
    description: str = ""
    ordinal: int = 0

    @property
    def is_key(self) -> bool:
        return "KEY" in self.status.upper()

    @property
    def is_required(self) -> bool:
        return "REQUIRED" in self.status.upper()


@dataclass
class Dictionary:
    edition: str = ""
    groups: dict[str, str | None] = field(default_factory=dict)  # code -> parent
    titles: dict[str, str] = field(default_factory=dict)
    headings: dict[str, list[Heading]] = field(default_factory=dict)
    abbreviations: dict[tuple[str, str], str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)

    @classmethod
    def empty(cls) -> Dictionary:
        return cls()

    @classmethod
    def from_text(cls, text: str, edition: str = "") -> Dictionary:
        out = cls(edition)
        columns: dict[str, list[str]] = {}
        for r in lexer.rows(text):
            if r.tag == "HEADING":
                columns[r.group] = [h.strip() for h in r.values]
            elif r.tag == "DATA" and r.group in columns:
                row = {h: v.strip() for h, v in zip(columns[r.group], r.values)}
                out._add(r.group, row)
        return out

    @classmethod
    def from_file(cls, path: str, edition: str = "") -> Dictionary:
        with open(path, "rb") as f:
            return cls.from_text(lexer.decode(f.read(), errors="replace")[0], edition)

    def _add(self, group: str, row: dict[str, str]) -> None:
        if group == "DICT":
            code = row.get("DICT_GRP", "")
            if row.get("DICT_TYPE", "").upper() == "GROUP":
                parent = row.get("DICT_PGRP", "")
                self.groups.setdefault(code, None if parent in ("", "-") else parent)
                self.titles.setdefault(code, row.get("DICT_DESC", ""))
            elif row.get("DICT_HDNG"):
                have = self.headings.setdefault(code, [])
                if all(h.name != row["DICT_HDNG"] for h in have):
                    have.append(Heading(code, row["DICT_HDNG"], row.get("DICT_STAT", ""), row.get("DICT_DTYP", "") or "X", row.get("DICT_UNIT", ""), row.get("DICT_DESC", ""), len(have) + 1))
        elif group == "ABBR":
            self.abbreviations.setdefault((row.get("ABBR_HDNG", ""), row.get("ABBR_CODE", "")), row.get("ABBR_DESC", ""))
        elif group == "TYPE":
            self.types.setdefault(row.get("TYPE_TYPE", ""), row.get("TYPE_DESC", ""))
        elif group == "UNIT":
            self.units.setdefault(row.get("UNIT_UNIT", ""), row.get("UNIT_DESC", ""))

    def layered(self, other: Dictionary) -> Dictionary:
        """This dictionary with what the other has beside it; this one wins, and no known group gets new keys."""
        out = Dictionary(self.edition, dict(self.groups), dict(self.titles), {g: list(h) for g, h in self.headings.items()}, dict(self.abbreviations), dict(self.types), dict(self.units))
        for g, parent in other.groups.items():
            out.groups.setdefault(g, parent)
            out.titles.setdefault(g, other.titles.get(g, ""))
        for g, found in other.headings.items():
            have = out.headings.setdefault(g, [])
            for h in found:
                if all(h.name != x.name for x in have):
                    known = g in self.groups
                    have.append(Heading(g, h.name, "OTHER" if known and h.is_key else h.status, h.type, h.unit, h.description, len(have) + 1))
        for mine, theirs in ((out.abbreviations, other.abbreviations), (out.types, other.types), (out.units, other.units)):
            for k, v in theirs.items():
                mine.setdefault(k, v)
        return out

    def parent(self, group: str) -> str | None:
        return self.groups.get(group)

    def ancestors(self, group: str) -> Iterator[str]:
        """Parents upwards; a cycle ends the walk."""
        seen = {group}
        while (group := self.groups.get(group)) and group not in seen:
            seen.add(group)
            yield group

    def children(self, group: str) -> list[str]:
        return sorted(g for g, p in self.groups.items() if p == group)

    def own_keys(self, group: str) -> list[str]:
        return [h.name for h in self.headings.get(group, []) if h.is_key]

    def key_chain(self, group: str | None) -> list[str] | None:
        """Key headings in the order in which ids take them: the group's own declaration, inherited ones first. None without keys."""
        if group is None or not (own := self.own_keys(group)):
            return None
        above = [k for a in reversed(list(self.ancestors(group))) for k in self.own_keys(a)]
        first = [k for k in dict.fromkeys(above) if k in own]
        return first + [k for k in own if k not in first]

    def depth(self, group: str) -> int:
        return sum(1 for _ in self.ancestors(group))

    def topological(self) -> list[str]:
        return sorted(self.groups, key=lambda g: (self.depth(g), g))

    def heading(self, group: str, name: str) -> Heading | None:
        return next((h for h in self.headings.get(group, []) if h.name == name), None)

    def anywhere(self, name: str) -> list[Heading]:
        return [h for hs in self.headings.values() for h in hs if h.name == name]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(edition, group, ordinal, heading, status, ags_type, unit, parent, description)."""
        rows = [(self.edition, g, h.ordinal, h.name, h.status, h.type, h.unit, self.groups.get(g), h.description) for g, hs in self.headings.items() for h in hs]
        return spark.createDataFrame(rows, "edition string, `group` string, ordinal int, heading string, status string, ags_type string, unit string, parent string, description string")

    def relationships(self, spark: SparkSession) -> DataFrame:
        """(child, parent, shared_keys)."""
        from ..functions.keys import shared_keys

        rows = [(g, p, shared_keys(self.own_keys(p), self.own_keys(g))) for g, p in self.groups.items() if p]
        return spark.createDataFrame(rows, "child string, parent string, shared_keys array<string>")

    def abbreviation_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.edition, h, c, d) for (h, c), d in self.abbreviations.items()], "edition string, heading string, code string, description string")

    def related(self, group: str, top_suffix: str = "_TOP", base_suffix: str = "_BASE") -> list[tuple[str, str, list[str]]]:
        """(other group, relation, join keys): ancestors, descendants, and siblings that share two keys or one and a depth band."""
        mine = {h.name for h in self.headings.get(group, [])}
        up = list(self.ancestors(group))
        out = [(a, "ancestor", [k for k in self.own_keys(a) if k in mine]) for a in up]
        for other in self.topological():
            if other == group or other in up:
                continue
            theirs = {h.name for h in self.headings.get(other, [])}
            if group in self.ancestors(other):
                out.append((other, "descendant", [k for k in self.own_keys(group) if k in theirs]))
            elif set(self.ancestors(other)) & set(up):
                shared = [k for k in self.own_keys(other) if k in self.own_keys(group)]
                banded = f"{other}{top_suffix}" in theirs and f"{other}{base_suffix}" in theirs
                if len(shared) >= 2 or shared and banded:
                    out.append((other, "sibling", shared))
        return [r for r in out if r[2]]
