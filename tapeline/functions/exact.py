"""Columns that agree with Python to the last digit: rounding half to even, shortest texts of doubles, canonical JSON.

All are built-in expressions of the engine, so they run where the rows are and need no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

#: 2^27 + 1 cuts a double into halves whose products are exact; from 2^53 on doubles are whole.
_CUT, _WHOLE = 134217729.0, 2.0**53


def half_even(x: Column | str, places: int) -> Column:
    """x rounded to `places` decimal places, judged by the exact value of the double; ties go to the even digit.

    The fraction times 10^places is held as a product and its error (an error-free transformation), so a tie is told
    from a near tie. The result is the double nearest to the decimal. NaN, infinities and nulls stay as they are.
    """
    if not 0 <= places <= 15:
        raise ValueError("places: 0 to 15")
    x = F.col(x) if isinstance(x, str) else x
    if not places:
        return F.rint(x)
    unit = 10.0**places

    def of(size: Column) -> Column:
        whole = F.floor(size).cast("double")
        product = F.struct(whole.alias("whole"), *[c.alias(name) for name, c in zip(("product", "error"), _product(size - whole, F.lit(unit)), strict=True)])
        return _let(_let(product, up), lambda v: joined(v["whole"], v["digits"]))

    def up(v: Column) -> Column:
        below = F.floor(v["product"]).cast("double")
        beyond = v["product"] - below - 0.5
        tie = (v["error"] > 0) | ((v["error"] == 0) & (below % 2 == 1))
        return F.struct(v["whole"].alias("whole"), (below + F.when((beyond > 0) | ((beyond == 0) & tie), 1.0).otherwise(0.0)).alias("digits"))

    def joined(whole: Column, digits: Column) -> Column:
        total = whole * unit + digits
        carried = F.when(digits >= unit, whole + 1).otherwise(whole).cast("long").cast("string")
        spelled = F.concat(carried, F.lit("."), F.lpad((digits % unit).cast("long").cast("string"), places, "0")).cast("double")
        return F.when(total < _WHOLE, total / unit).otherwise(spelled)

    plain = lambda x: F.isnan(x) | (F.abs(x) >= _WHOLE) | (x == 0)
    return _let(x, lambda x: F.when(plain(x), x).when(x < 0, -_let(-x, of)).otherwise(_let(x, of)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; an expression that is used often would else be copied as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def double_text(x: Column) -> Column:
    """The shortest decimal text that reads back as the double, as Python writes it; NaN and infinities are an error.

    The engine's own text reads back, but older Java versions give a digit too many at times: shorter texts beside it
    are tried, the nearer one first. (Where the engine's 17 digits end in 5 and both 16-digit neighbours read back, the
    nearer one is known from 1e-6 to 2^63; outside, the upper one is taken.)
    """

    def of(x: Column) -> Column:
        digits = _let(_let(_let(F.abs(x).cast("string"), _digits), _shorter(x)), _shorter(x))
        written = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), F.when(x == 0, "0.0").otherwise(_let(digits, _spelled)))
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a number is not finite"))).otherwise(written)

    return _let(x, of)


def _digits(text: Column) -> Column:
    """d, the digits of a number's text without zeros at the ends, and e, the power of ten of the first."""
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    joined, zero = F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0")
    lead = F.length(joined) - F.length(F.ltrim(joined, zero))
    first = F.length(F.split_part(mantissa, F.lit("."), F.lit(1))) - 1 - lead + F.coalesce(F.nullif(power, F.lit("")).cast("int"), F.lit(0))
    return F.struct(F.rtrim(F.ltrim(joined, zero), zero).alias("d"), first.alias("e"))


def _shorter(x: Column) -> Callable[[Column], Column]:
    """Digits of x with one less if that reads back; up to 15 digits of a normal number are the shortest already."""

    def one(number: Column, of: Column) -> Column:
        text = number.cast("string")
        return F.struct(F.rtrim(text, F.lit("0")).alias("d"), (of["e"] + F.length(text) - F.length(of["d"]) + 1).alias("e"))

    def candidates(of: Column) -> Column:
        number = of["d"].cast("long")
        low, high = (one(F.call_function("div", number, F.lit(10).cast("long")) + k, of) for k in (0, 1))
        below = (number % 10 < 5) | ((number % 10 == 5) & (_beyond(F.abs(x), number, of["e"]) < 0))
        return F.when(below, F.array(low, high)).otherwise(F.array(high, low))

    def reads(c: Column) -> Column:
        return F.concat(c["d"], F.lit("E"), (c["e"] - F.length(c["d"]) + 1).cast("string")).try_cast("double") == F.abs(x)

    return lambda of: F.when((F.length(of["d"]) <= 15) & (of["e"] > -308), of).otherwise(F.coalesce(F.get(F.filter(candidates(of), reads), F.lit(0)), of))


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded product of two doubles and its error; exact where nothing overflows."""
    cuts = [(c * _CUT) - (c * _CUT - c) for c in (a, b)]
    rests = [c - cut for c, cut in zip((a, b), cuts, strict=True)]
    whole = a * b
    return whole, ((cuts[0] * cuts[1] - whole) + cuts[0] * rests[1] + rests[0] * cuts[1]) + rests[0] * rests[1]


def _beyond(size: Column, number: Column, e: Column) -> Column:
    """The sign of size - number * 10^(e - 16), number having 17 digits; exact from 1e-6 to 2^63, 0 outside."""
    unit = F.get(F.array(*[F.lit(float(10**k)) for k in range(23)]), F.lit(16) - e)
    whole, error = _product(size, unit)
    small = (whole.cast("long") - number).cast("double") + error
    large = (size.cast("long") - number * F.when(e == 17, F.lit(10)).otherwise(F.lit(100))).cast("double")
    return F.when((e >= -6) & (e <= 16), small).when((e >= 17) & (e <= 18) & (size < 2.0**63), large).otherwise(0.0)


def _spelled(of: Column) -> Column:
    d, e, n = of["d"], of["e"], F.length(of["d"])
    zeros = lambda k: F.repeat(F.lit("0"), k)
    after = F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 99))).otherwise("")
    size = F.abs(e).cast("string")
    return (
        F.when((e < -4) | (e >= 16), F.concat(F.substring(d, 1, 1), after, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.lit("0")).otherwise(""), size))
        .when(e < 0, F.concat(F.lit("0."), zeros(-e - 1), d))
        .when(e >= n - 1, F.concat(d, zeros(e - n + 1), F.lit(".0")))
        .otherwise(F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, F.lit(99))))
    )


# The escapes of JSON texts that have a letter of their own; other control characters go by number.
_LETTERS = {"\n": r"\n", "\r": r"\r", "\t": r"\t", "\f": r"\f", "\b": r"\b"}


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters are escaped, nothing else is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _LETTERS.items(), out)
    rest = [chr(k) for k in range(32) if chr(k) not in _LETTERS]
    numbered = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"\\u{ord(x):04x}")), rest, named)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), numbered).otherwise(out), F.lit('"'))


def canonical_text(column: Column, kind: DataType) -> Column:
    """The canonical JSON of a column of this type: keys sorted, no spaces, lists in their order, nulls kept.

    Equal to `canonical.canonical_json` of the value. Dates are written as their ISO text. Types without a JSON form of
    their own (time stamps, decimals, binary, maps whose keys are no strings) raise TypeError; cast them first.
    """
    if isinstance(kind, StructType):
        if len(set(kind.names)) < len(kind.names):
            raise TypeError("two fields have one name")
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_text(column.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_text(e["value"], kind.valueType))
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(column), by_key), entry), ","), F.lit("}"))
    elif isinstance(kind, StringType):
        text = quoted(column)
    elif isinstance(kind, BooleanType | IntegralType):
        text = column.cast("string")
    elif isinstance(kind, DoubleType | FloatType):
        text = double_text(column.cast("double"))
    elif isinstance(kind, DateType):
        text = quoted(column.cast("string"))
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(column.isNull(), F.lit("null")).otherwise(text)


def canonical_row(schema: StructType) -> Column:
    """The canonical JSON of a whole row of a frame with this schema."""
    return canonical_text(F.struct(*[F.col(f"`{c}`") for c in schema.names]), schema)
