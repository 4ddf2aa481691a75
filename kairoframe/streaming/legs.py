"""Streams: bars as they become known, and positions stepped one bar at a time.

The knowledge instant is the event time. `windowed` aggregates what becomes known by windows with a watermark;
`stepped` keeps one position for each key in the state store and emits its exit, as the batch form does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulation import Leg, LegRules, step

STATE = "key double, atr double, entry double, shares long, first_key double, highest double, observed long, held long, pending string, low double, high double, done boolean"


def windowed(bars: DataFrame, late: str, width: str) -> DataFrame:
    """Bars, traded bars and volume for each window of the knowledge instant; rows later than `late` are left out."""
    known = bars.withWatermark("available_at", late).groupBy(F.window("available_at", width))
    made = known.agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("volume") > 0).alias("traded"), F.sum("volume").alias("volume"))
    return made.select(F.col("window.start").alias("start"), "bars", "traded", "volume")


def stepped(bars: DataFrame, rules: LegRules, atr: float, shares: int) -> DataFrame:
    """security_id, exit_day, exit_price, reason: each security is bought at its first bar's open and stepped from there."""
    names = [c.split(" ")[0] for c in STATE.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("session_date")
        leg, done = None, False
        if state.exists:
            kept = dict(zip(names, state.get, strict=True))
            done = kept.pop("done")
            leg = Leg(**kept)
        for r in rows.itertuples():
            if done:
                break
            if leg is None:
                leg = Leg(key=r.open, atr=atr, entry=r.open * (1 + rules.bps / 1e4), shares=shares, first_key=r.open - rules.hard_atr * atr, highest=r.open)
            leg, fill = step(leg, (r.open, r.high, r.low, r.close), rules)
            if fill:
                done = True
                yield pd.DataFrame({"security_id": [key[0]], "exit_day": [r.session_date], "exit_price": [fill[0]], "reason": [fill[1]]})
        state.update((leg.key, leg.atr, leg.entry, leg.shares, leg.first_key, leg.highest, leg.observed, leg.held, leg.pending, leg.low, leg.high, done))

    slim = bars.select("security_id", "session_date", "open", "high", "low", "close")
    return slim.groupBy("security_id").applyInPandasWithState(run, "security_id string, exit_day date, exit_price double, reason string", STATE, "append", GroupStateTimeout.NoTimeout)
