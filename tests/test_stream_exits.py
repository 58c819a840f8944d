"""Exits over a stream of bars equal those of the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tapeline.operators import market, replay
from tapeline.params import Params
from tapeline.streaming.exits import exits

P = Params(suspension_mode="as_of", max_hold=5)
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k + k // 5 * 2) for k in range(40)]  # five sessions a week


def market_rows(rng):
    """Bars of tickers that trade on all, most or few sessions, that stop, and that pause; every third opens a position."""
    out = []
    for t in range(12):
        price = 100.0
        for k in range(len(DAYS)):
            gone = (t % 4 == 1 and rng.random() < 0.4) or (t % 4 == 2 and 12 <= k < 12 + t) or (t % 4 == 3 and k > 20 + t)
            price = max(1.0, price + rng.uniform(-4, 4))
            if not gone:
                opens = rng.random() < 0.35
                low, high = price - rng.uniform(0, 4), price + rng.uniform(0, 4)
                out.append((f"T{t}", DAYS[k], rng.uniform(low, high), high, low, price, 1000.0, *((price, price - 6, price + 6) if opens else (None,) * 3)))
    return out


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "ticker string, date date, open double, high double, low double, close double, volume double, entry double, sl double, tp1 double"
    bars = spark.createDataFrame(market_rows(random.Random(6)), schema).cache()
    index = spark.createDataFrame([(d, 1.0) for d in DAYS], "date date, close double")
    dated = replay.dated_bars(bars, index, market.decision_dates(index, 0), P)
    signals = dated.where("entry is not null").select("ticker", "date", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    columns = ["ticker", "date", "entry", "exit_date", "exit", "exit_reason", "bars_held"]
    want = sorted(tuple(r) for r in replay.outcomes(signals, dated, P).where("exit_date is not null").select(*columns).collect())
    assert {r[5] for r in want} == {"TP_GAP", "SL_GAP", "STOP_LOSS", "TAKE_PROFIT_1", "TIME_EXIT", "TIME_EXIT_SUSPENDED"}

    source, target, state = f"{tmp_path}/bars", f"{tmp_path}/trades", f"{tmp_path}/state"
    got = []
    for part in (DAYS[:17], DAYS[17:31], DAYS[31:]):  # the query is stopped twice and goes on from its state
        for chunk in (part[k : k + 4] for k in range(0, len(part), 4)):
            bars.where(F.col("date").isin(chunk)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = exits(stream, DAYS, P).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(spark.read.parquet(target).count())
    rows = spark.read.parquet(target)
    assert sorted(tuple(r) for r in rows.select(*columns).collect()) == want
    assert 0 < got[0] < got[1] < got[2] == len(want)
