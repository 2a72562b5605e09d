"""Content-derived row ids, as column expressions.

An id is a version-8 UUID over the first 128 bits of SHA-256 of a length-prefixed encoding,
so tables keyed apart join without coordination. Everything is built-in functions: unused
ids are pruned and used ones stay in generated code.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tag that keeps value hashes apart from identities.
CONTENT_DOMAIN = "\x1fCONTENT2"
#: White space that ids and readers trim (Spark's trim takes spaces only).
SPACE = r"[\s\x0B\u0085   -     　]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _le32(n: Column) -> Column:
    """An int as four bytes, low byte first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def _const(text: str) -> Column:
    raw = text.encode()
    return F.lit(bytearray(struct.pack("<I", len(raw)) + raw))


def _prefixed(c: Column) -> Column:
    return F.concat(_le32(F.octet_length(c)), c.cast("binary"))


def _uuid8(encoded: Column) -> Column:
    h = F.sha2(encoded, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_id(group: str, chain: Sequence[tuple[str, Column | None]]) -> Column:
    """Id of a group's row from its key chain (heading, raw value); an absent heading or null is ``""``."""
    parts = [_const(group), F.lit(bytearray(struct.pack("<I", len(chain))))]
    for name, value in chain:
        parts.append(_const(name))
        parts.append(_const("") if value is None else _prefixed(F.coalesce(trimmed(value.cast("string")), F.lit(""))))
    return _uuid8(F.concat(*parts))


def content_hash(group: str, cells: Sequence[tuple[str, str, Column]]) -> Column:
    """Value hash of a row from (heading, unit, canonical text of the parsed value); null values are left out."""
    cells = sorted(cells, key=lambda c: c[0])
    count = sum((F.when(v.isNotNull(), 1).otherwise(0) for _, _, v in cells), F.lit(0))
    parts = [_const(group + CONTENT_DOMAIN), _le32(count)]
    for name, unit, value in cells:
        cell = F.concat(_const(name), _const(unit.strip()), _prefixed(value))
        parts.append(F.when(value.isNotNull(), cell).otherwise(F.lit(bytearray())))
    return _uuid8(F.concat(*parts))


def shared_keys(parent: Sequence[str], child: Sequence[str]) -> list[str]:
    """Key headings that a parent and a child both carry, in the parent's order."""
    return [k for k in parent if k in set(child)]


def engine_fingerprint() -> str:
    """SHA-256 over this package's sources: changes whenever a rule or an operator does."""
    root = Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        if "llm" not in file.relative_to(root).parts:
            h.update(str(file.relative_to(root)).encode() + b"\0" + file.read_bytes())
    return h.hexdigest()
