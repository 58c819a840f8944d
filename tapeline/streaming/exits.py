"""Exits of open positions over a stream of bars, with state and timers for each ticker.

The stream brings the bars of decision dates, each with the levels of a position that opens at its close, if one does
(entry, sl, tp1; else null). A ticker's state is its open positions with the bars they have been held, and its last bar.
Each later bar is held against the exit rules; a ticker without a bar for `max_hold` sessions counts as suspended, which
a timer tells: it goes off once the stream has passed that session. The sessions (all decision dates) are known
beforehand, as those of an exchange are. Bars that come later than `late` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeline.params import Params

OUT = "ticker string, date date, entry double, exit_date date, exit double, exit_reason string, bars_held long"
_EPOCH, _DAY_MS = date(1970, 1, 1), 86_400_000


def _exit(bar: Any, sl: float, tp1: float, held: int, p: Params) -> tuple[str, float] | None:
    """Reason and price of the exit that a bar brings, by the same rules in the same order as `features.exit_event`."""
    if bar.open >= tp1:
        return "TP_GAP", bar.open
    if bar.open <= sl:
        return "SL_GAP", bar.open
    if bar.low <= sl:
        return "STOP_LOSS", sl
    if bar.high >= tp1:
        return "TAKE_PROFIT_1", tp1
    return ("TIME_EXIT", bar.close) if held >= p.max_hold else None


class Exits(StatefulProcessor):
    def __init__(self, sessions: list[date], p: Params):
        self.days = [(d - _EPOCH).days for d in sorted(sessions)]
        self.number = {d: k for k, d in enumerate(self.days)}
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getListState("positions", "day int, entry double, sl double, tp1 double, held int")
        self.last = handle.getValueState("last", "day int, close double")

    def _halt(self, last: int) -> int | None:
        """The session at which a ticker with this last bar counts as suspended."""
        k = self.number[last] + self.p.max_hold
        return self.days[k] if k < len(self.days) else None

    def _suspended(self, ticker: str, found: list[tuple], at: int, close: float) -> list[tuple]:
        # a position without a bar of its own yet is closed at its entry
        return [self._row(ticker, x, at, close if x[4] else x[1], "TIME_EXIT_SUSPENDED", x[4]) for x in found]

    @staticmethod
    def _row(ticker: str, x: tuple, at: int, price: float, reason: str, held: int) -> tuple:
        return ticker, _EPOCH + timedelta(days=x[0]), x[1], _EPOCH + timedelta(days=at), price, reason, held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticker, out = key[0], []
        found = [tuple(x) for x in self.positions.get()] if self.positions.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        bars = pd.concat(list(rows)).sort_values("date", kind="stable")
        for bar in bars.itertuples(index=False):
            day = (bar.date - _EPOCH).days
            if last and found and (halt := self._halt(last[0])) is not None and halt < day:
                out += self._suspended(ticker, found, halt, last[1])
                found = []
            kept = []
            for x in found:
                event = _exit(bar, x[2], x[3], x[4] + 1, self.p)
                if event:
                    out.append(self._row(ticker, x, day, event[1], event[0], x[4] + 1))
                else:
                    kept.append((*x[:4], x[4] + 1))
            found, last = kept, (day, float(bar.close))
            if not pd.isna(bar.entry):
                found.append((day, float(bar.entry), float(bar.sl), float(bar.tp1), 0))
        self._keep(found, last)
        if out:
            yield self._frame(out)

    def _keep(self, found: list[tuple], last: tuple) -> None:
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if found:
            self.positions.put(found)
            if (halt := self._halt(last[0])) is not None:
                # just before the session's bars: the watermark gets there only once the session has been seen
                self.handle.registerTimer(halt * _DAY_MS - 1)
        else:
            self.positions.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [tuple(x) for x in self.positions.get()] if self.positions.exists() else []
        last = tuple(self.last.get())
        self.positions.clear()
        if found:
            yield self._frame(self._suspended(key[0], found, self._halt(last[0]), last[1]))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def exits(bars: DataFrame, sessions: list[date], p: Params = Params(), late: str = "0 seconds") -> DataFrame:
    """Closed trades of a stream of bars (ticker, date, open, high, low, close, entry, sl, tp1), as they close.

    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = bars.select("ticker", "date", *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "entry", "sl", "tp1")], F.col("date").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("ticker").transformWithStateInPandas(Exits(sessions, p), OUT, "Append", "EventTime")
