"""Joins whose keys may be hot: one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.functions.durable import durable

#: More rows than these of one key are dealt over several tasks of a join.
HOT_ROWS = 10_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(many: DataFrame, few: DataFrame, on: list[str], how: str, broadcast_rows: int, salts: int = 32) -> DataFrame:
    """Join a table whose keys may be hot with one of a row for each key.

    ``few`` is sent to every task if it is counted to be within ``broadcast_rows``; beyond that a
    key's rows are dealt over ``salts`` tasks, and its row of ``few`` is repeated for each. ``how``
    is inner, left, left_semi or left_anti; null keys match nothing. Rows are dealt by a hash of
    their other columns, so a task that runs again deals them alike.
    """
    counted = durable(few)
    if counted.count() <= broadcast_rows:
        return many.join(F.broadcast(counted), on, how)
    salt = fresh(many, "salt")
    others = [f.name for f in many.schema.fields if f.name not in on and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in others)) if others else F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = counted.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, salt], how).drop(salt)


def dealt_join(many: DataFrame, few: DataFrame, key: str, rows: str, how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """Join on a key whose row of ``few`` says, in the column ``rows``, how many rows of ``many`` have it.

    A key of more than ``hot`` rows is dealt over as many tasks as make up ``hot`` rows each; such
    keys are few (all rows over ``hot``), so their list is sent to every task. ``how`` is inner or
    left; null keys match nothing, and with left they are not shuffled. ``many`` should be a scan or
    a checkpoint: rows are dealt by their places in it, which have to be the same when a task runs again.
    """
    parts, part = fresh(many, "parts"), fresh(many, "part")
    few = durable(few)
    number = F.ceil(F.col(rows) / hot).cast("int")
    crowded = few.filter(F.col(rows) > hot).select(key, number.alias(parts))
    dealt = many.filter(F.col(key).isNotNull()).join(F.broadcast(crowded), key, "left")
    dealt = dealt.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    repeated = few.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1)))
    joined = dealt.join(repeated, [key, part], how).drop(part)
    if how == "inner":
        return joined
    return joined.unionByName(many.filter(F.col(key).isNull()), allowMissingColumns=True)
