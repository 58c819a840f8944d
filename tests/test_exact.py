"""Rounding, number texts and canonical JSON as Python does them."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.canonical import canonical_json
from tapeline.functions import exact


def doubles(rng, n):
    """Doubles of all kinds: any bits, short decimals, ties, neighbours of powers."""
    out = [0.0, -0.0, 0.5, 1.5, 2.5, 2.675, 0.125, 0.375, 1e16, 1e15, 123456789012345680.0, 1e-5, 1e-4, 5e-324, 1.7976931348623157e308, 2.0**-44, 2e23, 1e23, 9.007199254740993e15, 4503599627370497.5]
    out += [math.ldexp(1, k) for k in range(-1074, 1023, 3)] + [math.nextafter(math.ldexp(1, k), 0) for k in range(-1000, 1000, 7)]
    while len(out) < n:
        kind = rng.randrange(5)
        if kind == 0:
            x = struct.unpack("<d", rng.randbytes(8))[0]
            if not math.isfinite(x):
                continue
        elif kind == 1:
            x = rng.randrange(10**9) / 10 ** rng.randrange(1, 9)
        elif kind == 2:
            x = rng.randrange(10**6) / 2 ** rng.randrange(1, 12)  # ties
        elif kind == 3:
            x = rng.uniform(-1e6, 1e6)
        else:
            x = rng.randrange(1, 10**4) * 0.005 * rng.choice([1, 10, 0.1, 1e10])
        out.append(rng.choice([x, -x]))
    out += [rng.uniform(8, 9.2) * 10.0 ** rng.randrange(-6, 19) for _ in range(n // 2)]  # where neighbours of 16 digits may both read back
    return out


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(x,) for x in doubles(random.Random(8), 100_000)], "x double").repartition(4).cache()


def same(a, b):
    return a == b and math.copysign(1, a) == math.copysign(1, b)


@pytest.mark.parametrize("places", [0, 1, 2, 4, 6, 15])
def test_half_even(numbers, places):
    got = numbers.select("x", exact.half_even("x", places).alias("r")).collect()
    assert [r for r in got if not same(r.r, float(round(r.x, places)))] == []


def test_half_even_of_what_is_no_number(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    got = [r[0] for r in rows.select(exact.half_even("x", 2)).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, None]
    with pytest.raises(ValueError):
        exact.half_even("x", 16)


def test_double_text(numbers):
    got = numbers.select("x", exact.double_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != repr(r.x)] == []


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_what_is_not_finite_is_an_error(spark, bad):
    rows = spark.createDataFrame([({"a": [1.0, bad]},)], "m map<string,array<double>>")
    with pytest.raises(Exception, match="not finite"):
        rows.select(exact.canonical_row(rows.schema)).collect()


def test_canonical_rows(spark):
    schema = StructType.fromDDL("z string, a struct<y:array<struct<k:int,b:boolean>>, x:double>, `é` map<string,array<double>>, B long, m map<string,struct<q:string>>, e array<string>")
    odd = ['quote " and \\ back', "tab\tnewline\nreturn\rfeed\fback\b", "".join(map(chr, range(32))) + "\x7f", "é あ 😀  ", "", "/", "\\u0041", None]
    rows = []
    rng = random.Random(3)
    for text in odd:
        for _ in range(6):
            y = [{"k": rng.choice([None, 1, -5]), "b": rng.choice([True, False, None])} for _ in range(rng.randrange(3))]
            number = lambda: rng.choice([1.0, -0.0, 1e16, 1e-7, 2.5, rng.random(), 1e300])
            rows.append({
                "z": text,
                "a": rng.choice([None, {"y": y, "x": rng.choice([None, number()])}]),
                "é": rng.choice([None, {}, {k: [number()] for k in rng.sample(["b", "a", "Z", "é", "😀", "￿", ""], 5)}]),
                "B": rng.choice([0, -(2**63), 2**63 - 1, None]),
                "m": {(text or "k"): {"q": text}},
                "e": rng.choice([[], None, [text, None, "x"]]),
            })
    frame = spark.createDataFrame(rows, schema)
    got = frame.select("*", exact.canonical_row(schema).alias("t")).collect()
    for r in got:
        row = r.asDict(recursive=True)
        assert row.pop("t") == canonical_json(row)


def test_canonical_dates_and_types(spark):
    rows = spark.createDataFrame([(dt.date(2024, 2, 29), None)], "d date, v void")
    assert rows.select(exact.canonical_row(rows.schema)).first()[0] == '{"d":"2024-02-29","v":null}'
    for ddl in ("x timestamp", "x decimal(5,2)", "x binary", "x map<int,int>"):
        with pytest.raises(TypeError):
            exact.canonical_row(StructType.fromDDL(ddl))


def test_no_python_worker(spark):
    rows = spark.createDataFrame([(1.5, "a")], "x double, s string")
    plan = rows.select(exact.canonical_row(rows.schema), exact.half_even("x", 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
