"""Command line: validate, read, fix, diff, merge, certify, pack, unpack, excel."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import emit, fix, merge_files, rules, transfer
from .session import ship
from .sources import delivery
from .sources.dictionary import Dictionary
from .sources.lexer import DeliveryError

#: Fixed values, exit codes: fine, findings, usage, unreadable, changed content.
OK, FINDINGS, USAGE, UNREADABLE, STALE = 0, 1, 3, 4, 5


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="groupwise")
    p.add_argument("verb", choices=["validate", "read", "fix", "diff", "merge", "certify", "pack", "unpack", "excel"])
    p.add_argument("files", nargs="+")
    p.add_argument("--dictionary")
    p.add_argument("--group")
    p.add_argument("--out")
    p.add_argument("--risky", action="store_true")
    p.add_argument("--clash", default="error", choices=merge_files.CLASHES)
    p.add_argument("--missing-tran", default="reconcile", choices=merge_files.MISSING_TRAN)
    a = p.parse_args(args)
    out = a.out or a.files[0] + ".out"
    if a.verb in ("pack", "unpack"):
        try:
            made = (transfer.pack if a.verb == "pack" else transfer.unpack)(_bytes(a.files[0]))
        except DeliveryError as e:
            print(e, file=sys.stderr)
            return UNREADABLE
        with open(out, "wb") as f:
            f.write(made)
        return OK
    spark = ship(SparkSession.builder.getOrCreate())
    dictionary = Dictionary.from_file(a.dictionary) if a.dictionary else Dictionary.empty()
    try:
        if a.verb in ("validate", "certify"):
            records = delivery.scan(spark, a.files, errors="replace").cache()
            findings = rules.validate(records, dictionary).cache()
            if a.verb == "certify":
                counts = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
                print(json.dumps(transfer.certificate(_bytes(a.files[0]), counts, dictionary.edition)))
                return OK
            for r in emit.rows_json(findings.orderBy("file", "line", "rule")).toLocalIterator():
                print(r["value"])
            return FINDINGS if findings.where("severity = 'error'").take(1) else OK
        if a.verb == "fix":
            text, done = fix.fix_until_stable(_bytes(a.files[0]).decode("utf-8", "replace"), risky=a.risky)
            with open(out, "w", encoding="utf-8", newline="") as f:
                f.write(text)
            print(json.dumps(done))
            return OK
        read = [delivery.read(spark, f, dictionary=dictionary) for f in a.files]
        if a.verb == "read":
            for piece in emit.rows_csv(read[0].table(a.group) if a.group else read[0].group_catalog()):
                sys.stdout.write(piece)
        elif a.verb == "diff":
            added, removed, both = merge_files.diff(read[0], read[1], dictionary)
            print(json.dumps({"added": added, "removed": removed, "groups": {g: [r.asDict(True) for r in d.toLocalIterator()] for g, d in both.items()}}, default=str))
        elif a.verb == "merge":
            warnings: list[dict[str, str | None]] = []
            emit.write(merge_files.merge(read, dictionary, a.clash, a.missing_tran, warnings), out)
            for w in warnings:
                print(json.dumps(w), file=sys.stderr)
        else:
            emit.write_xlsx([emit.Block(g, read[0].raw(g), s.headings, s.units, s.types, ["data_row"]) for g, s in read[0].shapes.items()], out)
        return OK
    except DeliveryError as e:
        print(e, file=sys.stderr)
        return UNREADABLE


if __name__ == "__main__":
    sys.exit(main())
