"""A seeded shuffle buffer for streams: rows come out in another order, from state of a bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def pick(seed: int, shard: int, turn: int, size: int) -> int:
    """A number below ``size`` that depends on seed, shard and turn alone."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{turn}".encode(), digest_size=8).digest(), "big") % size


class ShuffleBuffer(StatefulProcessor):
    """Holds ``size`` rows of a shard: each new one takes the place of a random one, which goes out.

    State is one row for each place, the number of rows seen and that of rows
    sent, so a turn reads and writes one place. A closing row sends out what is
    left, in random order, and clears the state.
    """

    def __init__(self, size: int, seed: int, row: StructType):
        self.size, self.seed, self.row = size, seed, row
        self.names = row.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "place int", self.row)
        self.turns = handle.getValueState("turns", "seen long, sent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        seen, sent = self.turns.get() if self.turns.exists() else (0, 0)
        frame = pd.concat(list(rows), ignore_index=True)  # columns go by place: pandas frames rename odd names
        last = frame.iloc[:, 2].astype(bool)
        closes = bool(last.any())
        data = frame[~last].sort_values(frame.columns[1], kind="stable").iloc[:, 3:]
        out = []
        for values in data.astype(object).where(data.notna(), None).itertuples(index=False, name=None):
            if seen < self.size:
                self.places.updateValue((seen,), values)
            else:
                place = (pick(self.seed, shard, seen, self.size),)
                out.append(tuple(self.places.getValue(place)))
                self.places.updateValue(place, values)
            seen += 1
        if closes:
            left = [tuple(self.places.getValue((k,))) for k in range(min(seen, self.size))]
            while left:
                out.append(left.pop(pick(self.seed, shard, seen + len(left), len(left))))
            self.places.clear()
            self.turns.clear()
        else:
            self.turns.update((seen, sent + len(out)))
        yield pd.DataFrame([(shard, sent + k, *values) for k, values in enumerate(out)], columns=["shard", "turn", *self.names])

    def close(self) -> None:
        pass


def shuffled(rows: DataFrame, order: str, buffer: int = 1000, seed: int = 0, shards: int = 8, closes: str | None = None) -> DataFrame:
    """``(shard, turn, ...)``: the rows of a stream, each once, in a seeded order within each shard.

    ``order`` is a whole number that tells rows apart, such as an offset: it
    deals rows to ``shards`` and orders those of one batch, so the same batches
    give the same order again. Of each shard ``buffer`` rows are held back until
    a row whose boolean column ``closes`` is true ends the input; that row
    carries nothing itself. A table that is no stream is refused: it is ordered
    by a hash instead.
    """
    if buffer < 1 or shards < 1:
        raise ValueError("a buffer and shards need a positive size")
    if not rows.isStreaming:
        raise ValueError("a shuffle buffer is for streams")
    ends = F.coalesce(F.col(closes), F.lit(False)) if closes else F.lit(False)
    own = F.array(F.pmod(F.xxhash64(order), F.lit(shards)).cast("int"))
    to = F.when(ends, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)
    kept = [c for c in rows.columns if c != closes]
    dealt = rows.select(F.explode(to).alias("shard"), F.col(order).cast("long").alias("at"), ends.alias("closes"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    kind = StructType([f for f in rows.schema.fields if f.name != closes])
    out = StructType.fromDDL(f"shard int, turn long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kind.fields)}")
    return dealt.groupBy("shard").transformWithStateInPandas(ShuffleBuffer(buffer, seed, kind), out, "Append", "None")
