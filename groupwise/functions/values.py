"""Typed cells: codes to Spark types, text to values, values to text.

Parsing is built-in functions only. Formatting to a number of decimals or figures is by
exact binary value, half to even, which Spark's formatting (half up on the shortest text)
is not, so it is a pandas UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import trimmed

#: Codes whose cells are text, and the words of a yes/no cell.
TEXT_CODES = ("ID", "X", "PA", "PT", "PU", "T", "U", "DMS", "MC", "XN", "RL")
YES, NO = ("Y", "YES", "TRUE", "1"), ("N", "NO", "FALSE", "0")
#: Datetime layouts in the order in which they are tried.
DATETIMES = ("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")
#: Fixed value: most decimals or figures that a code may ask for.
MOST_DIGITS = 30
TIME_UNITS = ("hh:mm", "hh:mm:ss", "hh:mm:ss.sss")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def canonical(code: str | None) -> str:
    """string, integer, decimal, boolean or datetime."""
    c = (code or "X").strip().upper()
    if c == "0DP":
        return "integer"
    if re.fullmatch(r"[0-9]+(DP|SF|SCI)", c):
        return "decimal"
    return {"YN": "boolean", "DT": "datetime"}.get(c, "string")


def spark_type(code: str | None, unit: str = "") -> T.DataType:
    kind = canonical(code)
    if kind == "datetime" and unit.strip().lower() in TIME_UNITS:
        return T.StringType()  # a time of day; TIME needs a session flag, so it is ISO text
    return {"integer": T.LongType(), "decimal": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampNTZType()}.get(kind, T.StringType())


def sql_type(code: str | None, unit: str = "") -> str:
    kind = canonical(code)
    if kind == "datetime" and unit.strip().lower() in TIME_UNITS:
        return "TIME"
    return {"integer": "BIGINT", "decimal": "DOUBLE", "boolean": "BOOLEAN", "datetime": "TIMESTAMP"}.get(kind, "VARCHAR")


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def parse_decimal(c: Column) -> Column:
    s = trimmed(c)
    return F.when(s.rlike(_NUMBER), _finite(s.try_cast("double")))


def parse_integer(c: Column) -> Column:
    """Toward zero; null outside bigint."""
    x = parse_decimal(c)
    return F.when((x >= -9223372036854775808.0) & (x < 9223372036854775808.0), x.try_cast("bigint"))


def parse_bool(c: Column) -> Column:
    s = F.upper(trimmed(c))
    return F.when(s.isin(*YES), F.lit(True)).when(s.isin(*NO), F.lit(False))


def parse_datetime(c: Column, unit: str = "") -> Column:
    """The first layout that fits, as timestamp without zone; year or month units take that shape only."""
    s = trimmed(c)
    shape = unit.strip().lower()
    if shape in ("yyyy", "yyyy-mm"):
        whole = F.concat(s, F.lit("-01-01" if shape == "yyyy" else "-01"))
        return F.when(s.rlike(r"^[0-9]{4}\z" if shape == "yyyy" else r"^[0-9]{4}-[0-9]{2}\z"), _at(whole, "yyyy-MM-dd"))
    return F.coalesce(*[_at(s, f) for f in DATETIMES])


def _at(s: Column, layout: str) -> Column:
    return F.try_to_timestamp(s, F.lit(layout)).cast("timestamp_ntz")


def parse_time(c: Column) -> Column:
    s = trimmed(c)
    ok = s.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?\z")
    return F.when(ok, F.when(F.length(s) <= 5, F.concat(F.lpad(s, 5, "0"), F.lit(":00"))).otherwise(s))


def parse(c: Column, code: str | None, unit: str = "", xn_numeric: bool = False) -> Column:
    """A cell's value by its type code; blank and bad cells are null."""
    kind = canonical(code)
    if (code or "").strip().upper() == "XN" and xn_numeric:
        return parse_decimal(c)
    if kind == "datetime":
        return parse_time(c) if unit.strip().lower() in TIME_UNITS else parse_datetime(c, unit)
    s = trimmed(c)
    return {"integer": parse_integer, "decimal": parse_decimal, "boolean": parse_bool}.get(kind, lambda _: F.when(s != "", s))(c)


@F.pandas_udf(T.StringType())
def _number_text(column: pd.Series) -> pd.Series:
    """Shortest text of doubles, always with a point or an exponent, as JSON writers give it."""

    def one(x: float) -> str:
        digits = repr(x)
        if "e" not in digits:
            return digits
        head, tail = digits.split("e")
        return f"{head}e{int(tail)}" if int(tail) < 0 else f"{head}e+{int(tail)}"

    return column.map(one, na_action="ignore")


def canonical_text(c: Column, code: str | None) -> Column:
    """Text of the parsed value, which value hashes are made of."""
    kind = canonical(code)
    value = parse(c, code)
    if kind == "decimal":
        return _number_text(value)
    if kind == "datetime":
        at = parse_datetime(c)
        whole = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(at, "SSSSSS")
        return _json_text(F.concat(whole, F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))))
    if kind == "string":
        return _json_text(value)
    return value.cast("string")


def _json_text(c: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


#: Exact sums of powers of two need this many digits at most.
_EXACT = Context(prec=1200, rounding=ROUND_HALF_EVEN)


def _at_place(x: float, place: int, how: str = ROUND_HALF_EVEN) -> Decimal:
    """``x``, exactly, rounded to the decimal place 10 ** place."""
    return Decimal(x).quantize(Decimal((0, (1,), place)), rounding=how, context=_EXACT)


def format_ndp(x: float, n: int) -> str:
    """n decimals, half to even on the exact value."""
    return format(_at_place(x, -min(n, MOST_DIGITS)), "f")


def format_nsf(x: float, n: int) -> str:
    """n significant figures as a plain decimal; whole tens and up are rounded half away from zero."""
    n = min(n, MOST_DIGITS)
    exact = Decimal(x)
    if not exact:
        return "0." + "0" * (n - 1) if n > 1 else "0"
    last = exact.adjusted() - n + 1  # the place of the last figure
    rounded = _at_place(x, last)
    last += rounded.adjusted() - exact.adjusted()  # 9.99 may round to 10.0, which has one place less
    if last <= 0:
        return format(_at_place(x, last), "f")
    return format(_at_place(x, last, ROUND_HALF_UP), "f")


def format_nsci(x: float, n: int) -> str:
    """One digit, a point, n decimals, a lower-case e, and the exponent without padding."""
    n = min(n, MOST_DIGITS)
    exact = Decimal(x)
    sign, digits, power = _at_place(x, exact.adjusted() - n).as_tuple() if exact else (Decimal(x).as_tuple().sign, (0,) * (n + 1), -n)
    figures = "".join(map(str, digits)).ljust(n + 1, "0")
    power += len(digits) - 1
    return f"{'-' if sign else ''}{figures[0]}.{figures[1 : n + 1]}e{power}"


def formatter(code: str) -> Callable[[float], str] | None:
    """The text of a number under a type code, or None where the code isn't numeric."""
    m = re.fullmatch(r"([0-9]+)(DP|SF|SCI)", code.strip().upper())
    if not m:
        return None
    n = int(m[1])
    return {"DP": lambda x: format_ndp(x, n), "SF": lambda x: format_nsf(x, n), "SCI": lambda x: format_nsci(x, n)}[m[2]]


def formatted(c: Column, code: str) -> Column:
    """A column of doubles as text under a type code."""
    make = formatter(code)
    if make is None:
        return c.cast("string")

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(make, na_action="ignore")

    return run(c)


def pad_decimals(c: Column, n: int) -> Column:
    """Zeros added on the right up to n decimals; text stays text, so no digit changes."""
    plain = c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?\z")
    have = F.when(F.instr(c, ".") > 0, F.length(c) - F.instr(c, ".")).otherwise(0)
    pointed = F.when(F.instr(c, ".") > 0, c).otherwise(F.concat(c, F.lit("." if n else "")))
    return F.when(plain & (have < n), F.concat(pointed, F.repeat(F.lit("0"), F.lit(n) - have))).otherwise(c)


def decimal_places(code: str) -> int | None:
    m = re.fullmatch(r"([0-9]+)DP", code.strip().upper())
    return int(m[1]) if m else None


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def is_ndp(c: Column, n: int) -> Column:
    """-?digits.digits with n decimals; without decimals the point may stay."""
    return c.rlike(r"^-?[0-9]+\.?\z" if n == 0 else rf"^-?[0-9]+\.[0-9]{{{n}}}\z")


def is_nsci(c: Column, n: int) -> Column:
    return c.rlike(rf"^-?[0-9]\.[0-9]{{{n}}}[eE][+-]?[0-9]+\z")


def is_dms(c: Column) -> Column:
    """Degrees, minutes, seconds; a point, with decimals or without, may follow."""
    return c.rlike(r"^-?[0-9]+:[0-5][0-9]:[0-5][0-9](\.[0-9]*)?\z")


def is_elapsed(c: Column, unit: Column | None = None) -> Column:
    """Elapsed time by its unit: hh:mm (two hour digits at least), mm:ss, else hours, minutes and seconds."""
    full = c.rlike(r"^[0-9]+:[0-5][0-9]:[0-5][0-9]\z")
    if unit is None:
        return full
    by_unit = F.when(F.trim(unit) == "hh:mm", c.rlike(r"^[0-9]{2,}:[0-5][0-9]\z")).when(F.trim(unit) == "mm:ss", c.rlike(r"^[0-5][0-9]:[0-5][0-9]\z"))
    return by_unit.otherwise(full)


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, each counted once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


#: Characters that codes are written with or without, and most suggestions of a hint.
SEPARATORS = "-_./"
MOST_HINTS = 3
_BARE = str.maketrans("", "", SEPARATORS)


def close_matches(value: str, known: Iterable[str], most: int = MOST_HINTS) -> list[str]:
    """Other codes near a value, nearest first: alike but for case, then for separators, then within few edits.

    One edit is allowed where the longer code has up to six characters, else two; codes of
    fewer than four characters are never matched by edits.
    """
    low = value.lower()

    def rank(code: str) -> tuple[int, int] | None:
        other = code.lower()
        if other == low:
            return 1, 0
        edits = edit_distance(low, other)
        if (bare := low.translate(_BARE)) and bare == other.translate(_BARE):
            return 2, edits
        short, long = sorted((len(value), len(code)))
        return (3, edits) if short >= 4 and edits <= (1 if long <= 6 else 2) else None

    near = {code: r for code in known if code != value and (r := rank(code))}
    return sorted(near, key=lambda code: (near[code], code))[:most]
