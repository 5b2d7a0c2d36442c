"""Rounds that close. Rows of a round arrive over time; a round closes at a time of its own,
and what comes later is late. Every row leaves as one of several kinds:

* ``closed``: the first row of its id, handed over when the watermark passes the closing time
  (with ``hold``), or ``first``, at once (without);
* ``repeated``: its id was there already;
* ``late``: it arrived at or after the closing time, or its round has been handed over.

What is still held belongs to open rounds. A round is dealt to ``salts`` keys, each with its own
state and timer; all timers of a round fire in one micro-batch, so a batch that has rows of a
closed round has them all. State of a closed round is gone: lateness is told by time.

``arrived`` is when a row came in. Spark drops rows whose ``arrived`` is ``slack`` or more older
than the newest one of earlier batches before they get here; ``require_none_dropped`` raises then."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from eralens.functions.checks import CheckFailed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


WHOLE = ("tinyint", "smallint", "int", "bigint")
BLOCK = 8192                     # rows of a state entry


def plain(column: pd.Series, kind: str) -> list:
    """Values as Python's own, null as None; pandas turns whole numbers with nulls into floats."""
    missing = column.isna()
    return [None if m else int(x) if kind in WHOLE else x for x, m in zip(column.tolist(), missing)]


class RoundState(StatefulProcessor):
    """One share of a round: its rows by id until the round closes. A micro-batch adds its new ids
    as blocks of up to ``BLOCK`` rows, one state entry each: a call to the state store costs far
    more than a row, so calls must not grow with rows. A block is read once per micro-batch
    that has rows of the share; where nothing is held, ids alone are kept."""

    def __init__(self, ids: list[str], types: dict[str, str], hold: bool):
        self.ids, self.types, self.hold = ids, types, hold
        self.rest = [c for c in types if c not in ids]

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block int", "rows binary")

    def stored(self) -> Iterator[tuple[int, tuple[list, list]]]:
        """Blocks by number: ids, and the other columns' values (empty without holding)."""
        for (block,), (rows,) in self.blocks.iterator():
            yield block, pickle.loads(rows)

    def put(self, block: int, ids: list, values: list) -> None:
        self.blocks.updateValue((block,), (pickle.dumps((ids, values), pickle.HIGHEST_PROTOCOL),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, timers, seen, block = timerValues.getCurrentWatermarkInMs(), set(), None, 0
        new, held = [], []
        for frame in rows:
            kinds = []
            ids = list(zip(*(plain(frame[c], self.types[c]) for c in self.ids)))
            values = list(zip(*(plain(frame[c], self.types[c]) for c in self.rest))) if self.hold and self.rest else [()] * len(ids)
            for one, value, closes, arrived in zip(ids, values, frame["closes_ms"].tolist(), frame["arrived_ms"].tolist()):
                if arrived >= closes or closes <= now:
                    kinds.append("late")
                    continue
                if seen is None:                # only if a row needs it: late ones do not
                    seen = set()
                    for number, (before, _) in self.stored():
                        seen.update(before)
                        block = max(block, number + 1)
                if one in seen:
                    kinds.append("repeated")
                    continue
                seen.add(one)
                new.append(one)
                if self.hold:
                    held.append(value)
                if len(new) == BLOCK:
                    self.put(block, new, held)
                    new, held, block = [], [], block + 1
                if closes not in timers:
                    self.handle.registerTimer(closes)
                    timers.add(closes)
                kinds.append(None if self.hold else "first")
            out = frame[list(self.types)].astype({c: "Int64" for c, t in self.types.items() if t in WHOLE}).assign(kind=kinds)
            yield out[out["kind"].notna()]
        if new:
            self.put(block, new, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.hold:
            for _, (ids, values) in self.stored():
                columns = zip([*self.ids, *self.rest], zip(*(one + value for one, value in zip(ids, values))))
                held = {c: pd.Series(list(v), dtype="Int64" if self.types[c] in WHOLE else None) for c, v in columns}
                yield pd.DataFrame(held)[list(self.types)].assign(kind="closed")
        self.blocks.clear()

    def close(self) -> None:
        pass


def by_round(stream: DataFrame, round_key: str, ids: Sequence[str], arrived: str, closes: str, slack: str = "1 millisecond",
             hold: bool = True, salts: int = 16) -> DataFrame:
    """The stream's rows with their ``kind``. ``arrived`` and ``closes`` are timestamps; ``closes`` is
    the same in all rows of a round. Rows without a round or a closing time are late."""
    cols = [c for c in stream.columns if c != closes]
    types = {c: t for c, t in stream.drop(closes).dtypes if c != arrived}
    # a key of one string: pandas turns whole numbers into floats where a batch has a null, keys too
    share = F.concat_ws(":", F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("string"), F.col(round_key).cast("string"))
    rows = stream.withWatermark(arrived, slack).select(
        *[c for c in cols if c != arrived], arrived, F.unix_millis(arrived).alias("arrived_ms"),
        F.coalesce(F.unix_millis(closes), F.lit(0)).alias("closes_ms"), share.alias("share"))
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", kind string"
    conf = stream.sparkSession.conf
    if conf.get(PROVIDER, None) != ROCKSDB:
        conf.set(PROVIDER, ROCKSDB)             # map states and timers need it; it is read when a query starts
    return rows.groupBy("share").transformWithStateInPandas(RoundState(list(ids), types, hold), schema, "append", "eventtime")


def require_none_dropped(progress) -> None:
    """Raise if a stateful operator has dropped rows that came too far out of order."""
    dropped = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    if dropped:
        raise CheckFailed(f"arrivals: {dropped} rows came later than the slack and were dropped")
