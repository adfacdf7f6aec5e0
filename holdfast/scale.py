"""What keeps an operator safe when one key holds a third of the rows.

Four tools are shared by the operators:

* ``durable``      cuts lineage with a table written in the shared checkpoint folder.
* ``skew_join``    an equi-join that salts only the keys that are really hot.
* ``dealt``        gives every task a bounded number of rows to aggregate.
* ``bounded_rows`` checks the size of a table before it may be broadcast.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast by hint only when it was counted and is at most this long.
BROADCAST_ROWS = 100_000
# A key is worth salting when it holds more than this number of rows: fewer are no burden for one task.
HOT_ROWS = 200_000
# Rows of keys that are nearly all distinct which one task aggregates at a time.
TASK_ROWS = 500_000
# Keys the sketch tracks, and the most of them it reports, which bounds what reaches the driver. A key
# with less than a part in SKETCH of the rows is left to AQE.
SKETCH = 8192
HOT_KEYS = 1000
# A hot key is dealt over as many tasks as its rows ask for, and over no more than this in all.
SALTS = 2000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; a scratch one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back: survives lost executors.

    Parquet rather than a row checkpoint: later steps read only the columns they need, and the
    planner knows the size.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> int | None:
    """Number of rows when at most ``limit``, else None.

    A count, not a ``limit``: the rows stay in their tasks, whatever their number.
    """
    found = df.count()
    return found if found <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a counted, small table; otherwise leave the plan to AQE."""
    return df if bounded_rows(df, limit) is None else F.broadcast(df)


def hot_hashes(df: DataFrame, keys: Sequence[str], share: float = 0.0) -> dict[int, int]:
    """Hashes of the keys that hold more than HOT_ROWS rows (and ``share`` of all), with their number of salts.

    One map-side sketch of fixed size per task; nothing else is shuffled, and at most HOT_KEYS
    numbers come back, whatever the size of ``df``. Whether a key is on the list decides only
    how its rows are spread, never the result. A key gets a salt for every HOT_ROWS rows, or for
    every part in SALTS of the table where that is more.
    """
    row = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_KEYS}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    floor, each = max(share * row["n"], HOT_ROWS), max(1, HOT_ROWS, row["n"] / SALTS)
    return {item["item"]: max(2, math.ceil(item["count"] / each)) for item in row["top"] or [] if item["count"] > floor}


def dealt(df: DataFrame, on: str, rows: int, hot: Mapping[int, int]) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``on`` with about TASK_ROWS rows a task; as it is when keys are hot.

    For aggregations and joins on ``on`` and more that hardly reduce the rows: a task's hash table is then as
    large as its part, however large the table, and what follows on the same key needs no shuffle. Rows of
    hot keys do shrink before a shuffle, so they are left to that.
    """
    if hot:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), on)


def skew_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner",
              condition: Column | None = None, probe: DataFrame | None = None,
              hot: Mapping[int, int] | None = None) -> DataFrame:
    """Join a large ``fact`` to ``dim`` on ``on``; rows of hot keys are spread, the hotter the wider.

    ``how`` is inner, left, left_semi or left_anti; ``condition`` is a further condition on
    columns that only one side has. The hot keys are found on ``probe``, by default ``fact``: pass
    the table underneath when ``fact`` is itself an aggregation, so that it is not made twice.
    Only the dimension rows of the hot keys are repeated. A dimension that Catalyst or AQE
    measures as small is still broadcast, and AQE still splits what the sketch left alone.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    if hot is None:
        hot = hot_hashes(fact if probe is None else probe, on)
    keys = list(on)
    if hot:
        # The map task is part of the salt, so that exact copies of one row are spread too; it
        # does not depend on the order of rows, so a task run again salts every row as before.
        values = [F.col(c) for c in fact.columns if not _is_map(fact, c)]
        # HOT_KEYS rows at most, so it is broadcast.
        salts = F.broadcast(fact.sparkSession.createDataFrame([(h, n) for h, n in hot.items()], "_hot long, _salts int"))
        spread = F.pmod(F.xxhash64(F.spark_partition_id(), *values), F.coalesce("_salts", F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        fact = (fact.join(salts, F.xxhash64(*on) == F.col("_hot"), "left").withColumn("_salt", spread).drop("_hot", "_salts"))
        dim = (dim.join(salts, F.xxhash64(*on) == F.col("_hot"), "left").withColumn("_salt", F.explode(copies)).drop("_hot", "_salts"))
        keys.append("_salt")
    if condition is None:
        return fact.join(dim, keys, how).drop("_salt")
    renamed = dim.withColumnsRenamed({k: f"_dim_{k}" for k in keys})
    same = condition
    for k in keys:
        same = same & (F.col(k) == F.col(f"_dim_{k}"))
    return fact.join(renamed, same, how).drop("_salt", *[f"_dim_{k}" for k in keys])


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")
