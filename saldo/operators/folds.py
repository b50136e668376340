"""Requests in order against a running balance per key: a refused request changes nothing, so later ones don't see it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _fold(batches):
    now, balance, used = object(), None, set()
    for b in batches:
        keys, start, delta, floor, name, again = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "_start", "_delta", "_floor", "_name", "_again"))
        before, applied, replay = [], [], []
        for k, s, d, low, n, more in zip(keys, start, delta, floor, name, again, strict=True):
            if k != now:
                now, balance, used = k, s, set()
            repeated = n is not None and n in used
            ok = not repeated and d is not None and balance is not None and (d >= 0 or balance + d >= low)
            before.append(balance)
            applied.append(ok)
            replay.append(repeated)
            if ok:
                balance += d
                if more and n is not None:
                    used.add(n)
            elif repeated and not more:
                used.discard(n)
        rest = [c for c in b.schema.names if c not in ("_key", "_start", "_delta", "_floor", "_name", "_again")]
        yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(before, pa.int64()), pa.array(applied, pa.bool_()), pa.array(replay, pa.bool_())], names=[*rest, "_before", "applied", "replay"])


def fold(rows: DataFrame, keys: list[str], order: str, start: Column, delta: Column, floor: Column | None = None, name: str | None = None) -> DataFrame:
    """Adds before (the key's balance when the request comes), applied and replay.

    A request of `delta` (null: never applied) is applied if the balance, which begins at `start`, doesn't fall below `floor` (0 if not
    given) by it. A request whose `name` an applied one of its key had is a replay. Requests of a key are read in `order` as a
    sorted stream; what is held is the key's balance, and the names that come again.
    """
    from pyspark.sql import Window

    cents = lambda c: (c.cast(MONEY) * 100).cast("long")
    later = F.lit(False) if name is None else F.lead(name).over(Window.partitionBy(*keys, name).orderBy(order)).isNotNull()
    df = rows.select("*", F.xxhash64(*keys).alias("_deal"), F.to_json(F.struct(*keys)).alias("_key"), cents(start).alias("_start"), cents(delta).alias("_delta"), cents(F.lit(0) if floor is None else floor).alias("_floor"),
                     (F.lit(None) if name is None else F.col(name)).cast("string").alias("_name"), later.alias("_again"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = df.repartition("_deal").sortWithinPartitions("_deal", "_key", order).drop("_deal").mapInArrow(_fold, f"{schema}, _before long, applied boolean, replay boolean")
    return out.withColumn("before", (F.col("_before").cast("decimal(20,0)") / 100).cast(MONEY)).drop("_before")


def _moves(batches):
    now, held = object(), {}
    for b in batches:
        key, kind, source, target, cents = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "_kind", "source", "target", "_cents"))
        outcome, left, there = [], [], []
        for k, what, a, z, n in zip(key, kind, source, target, cents, strict=True):
            if k != now:
                now, held = k, {}
            if what == 0:
                held[a] = n
                said = None
            elif not a or not z or a == z or n is None or n <= 0:
                said = "invalid"
            elif a not in held or z not in held:
                said = "unknown"
            elif held[a] < n:
                said = "short"
            else:
                held[a] -= n
                held[z] += n
                said = "moved"
            outcome.append(said)
            left.append(held.get(a))
            there.append(held.get(z))
        rest = [c for c in b.schema.names if c not in ("_key", "_cents")]
        told = pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(outcome, pa.string()), pa.array(left, pa.int64()), pa.array(there, pa.int64())], names=[*rest, "outcome", "_left", "_there"])
        yield told.filter(pa.array([x == 1 for x in kind]))


def fold_moves(requests: DataFrame, balances: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Moves (keys, order, source, target, amount) between the balances (keys, name, balance) of a key, in order: a move sees what those before
    it have left, as a source and as a target. Adds outcome (moved, short, unknown, invalid) and source_after and target_after.

    A key's balances come first in a sorted stream, its requests after them: what is held is a number for each of its names.
    """
    cents = lambda c: (c.cast(MONEY) * 100).cast("long").alias("_cents")
    key = F.to_json(F.struct(*keys)).alias("_key")
    first = balances.select(*keys, F.lit(None).cast(requests.schema[order].dataType).alias(order), F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("_kind"), key, cents(F.col("balance")))
    rows = first.unionByName(requests.select(*keys, order, "source", "target", F.lit(1).alias("_kind"), key, cents(F.col("amount"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("_key", "_cents"))
    out = rows.repartition("_key").sortWithinPartitions("_key", "_kind", order).mapInArrow(_moves, f"{schema}, outcome string, _left long, _there long")
    back = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast(MONEY)
    return out.select(*keys, order, "source", "target", "outcome", back("_left").alias("source_after"), back("_there").alias("target_after"))
