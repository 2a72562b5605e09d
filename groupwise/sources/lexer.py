"""Reading grouped text: records, fields, and the tolerant parse of one file.

A record ends at CRLF, LF or a lone CR outside quotes, so quoted line ends stay in their
record; line numbers are physical. Fields are quoted with doubled quotes inside, or run
bare to the comma; an unterminated quote runs to the end, and junk between a closing quote
and the comma is skipped.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

TAGS = ("GROUP", "HEADING", "UNIT", "TYPE", "DATA")
_BREAK = re.compile(r'"|\r\n|\n|\r')


class DeliveryError(ValueError):
    """A file that can't be read; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Record:
    rec: int
    line: int
    text: str
    terminator: str
    offset: int  # characters from the start of the decoded text


def decode(raw: bytes, encoding: str = "utf-8", errors: str = "strict") -> tuple[str, bool]:
    """Text and whether it began with a byte-order mark."""
    if len(raw) >= 1 << 32:
        raise DeliveryError("TooLarge", "files of 4 GiB and more are not read")
    bom = raw.startswith(codecs.BOM_UTF8)
    try:
        return raw[3 if bom else 0 :].decode(encoding, errors), bom
    except (UnicodeDecodeError, LookupError) as e:
        raise DeliveryError("NotUtf8", str(e)) from e


def records(text: str) -> Iterator[Record]:
    """Records with their own line ends."""
    start = at = 0
    rec, line, inner, open_quote = 0, 1, 0, False
    while m := _BREAK.search(text, at):
        at = m.end()
        if m[0] == '"':
            open_quote = not open_quote
        elif open_quote:
            inner += 1
        else:
            yield Record(rec, line, text[start : m.start()], m[0], start)
            rec, line, inner, start = rec + 1, line + inner + 1, 0, at
    if start < len(text):
        yield Record(rec, line, text[start:], "", start)


def fields(record: str) -> list[str]:
    """The fields of one record. A trailing comma opens no field."""
    out, at, n = [], 0, len(record)
    while at < n:
        if record[at] == '"':
            at += 1
            piece = []
            while True:
                end = record.find('"', at)
                if end < 0:
                    piece.append(record[at:])
                    at = n
                    break
                piece.append(record[at:end])
                if record[end + 1 : end + 2] == '"':
                    piece.append('"')
                    at = end + 2
                else:
                    at = end + 1
                    break
            out.append("".join(piece))
            comma = record.find(",", at)
            at = n if comma < 0 else comma + 1
        else:
            comma = record.find(",", at)
            out.append(record[at:] if comma < 0 else record[at:comma])
            at = n if comma < 0 else comma + 1
    return out


def strictly_quoted(record: str) -> bool:
    """Whether every field is quoted and every inner quote doubled."""
    return re.fullmatch(r'"(?:[^"]|"")*"(?:,"(?:[^"]|"")*")*', record) is not None


@dataclass
class Row:
    """A record in its place: ``group`` is that of the latest GROUP record, ``section`` counts these."""

    record: Record
    tag: str
    group: str | None
    section: int
    data_row: int | None
    values: list[str]


def rows(text: str) -> Iterator[Row]:
    """The tolerant parse: every record that isn't blank, with its group."""
    group, section = None, 0
    seen: dict[str, int] = {}
    for r in records(text):
        parts = fields(r.text)
        if not parts or not r.text.strip():
            continue
        tag = parts[0].strip()
        if tag == "GROUP":
            group = parts[1].strip() if len(parts) > 1 else ""
            section += 1
        n = None
        if tag == "DATA" and group is not None:
            n = seen[group] = seen.get(group, 0) + 1
        yield Row(r, tag, group, section, n, parts[1:])


def check_readable(text: str) -> None:
    """Errors for text of another format or edition."""
    head = text.lstrip()[:4096]
    if head.startswith('"**') or '"<UNITS>"' in head or '"<CONT>"' in head:
        raise DeliveryError("UnsupportedEdition", "an edition 3 file")
    if text.strip() and not any(r.tag == "GROUP" for r in rows(text)):
        raise DeliveryError("NotGrouped", "no GROUP record")


def byte_index(raw: bytes, encoding: str = "utf-8") -> list[tuple[str, int, int]]:
    """(group, first byte, end byte) of every GROUP record's section."""
    text, bom = decode(raw, encoding, "replace")
    marks = [(r.values[0].strip() if r.values else "", r.record.offset) for r in rows(text) if r.tag == "GROUP"]
    skip = 3 if bom else 0
    at = [skip + len(text[:o].encode(encoding, "replace")) for _, o in marks] + [len(raw)]
    return [(g, at[i], at[i + 1]) for i, (g, _) in enumerate(marks)]
