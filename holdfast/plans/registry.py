"""The query registry, and the test tables in the roles of a licence register.

A query is registered with the SQL that has to give the same rows. Two stars are used:

* the register: lineitem = device, orders = licence, customer = holder, part = site;
* the masts: orders = site, lineitem = device, supplier = licence and holder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.bands import Bands
from holdfast.scale import skew_join

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when there is one."""
    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return add


PRICE_BANDS = Bands((
    (0.0, 2000.0, "floor"), (2000.0, 5000.0, "low"), (5000.0, 12000.0, "lower middle"),
    (12000.0, 25000.0, "middle"), (25000.0, 40000.0, "upper middle"), (40000.0, 60000.0, "high"),
    (60000.0, 90000.0, "very high"), (90000.0, 100000.0, "top"), (100000.0, None, "open end"),
    ))
_VALUES = ", ".join(f"({i}, {lo}, {'NULL' if hi is None else hi}, '{name}')"
                    for i, (lo, hi, name) in enumerate(PRICE_BANDS.rows))

# Shared SQL: the same roles for the oracle.
BANDS_SQL = f"bands(band, lo, hi, band_name) AS (VALUES {_VALUES})"
REGISTER_SQL = """
lic AS (SELECT o_orderkey AS licence, o_custkey AS holder, o_orderstatus = 'F' AS granted,
               o_orderpriority AS service, o_orderdate AS issued, c_mktsegment AS class,
               c_acctbal < 0 AS person
        FROM orders JOIN customer ON c_custkey = o_custkey),
dev AS (SELECT l_orderkey AS licence, l_partkey AS site, l_extendedprice AS value,
               l_linestatus = 'O' AS tx, l_linestatus AS direction, l_shipdate AS authorised
        FROM lineitem)"""
MAST_SQL = """
mast AS (SELECT l_orderkey AS site, l_suppkey AS holder, l_linestatus = 'O' AS tx FROM lineitem),
sup AS (SELECT s_suppkey AS holder, s_nationkey AS class, s_acctbal < 0 AS person,
               s_acctbal >= 500 AS granted FROM supplier),
tenants AS (SELECT site, holder, class, person, bool_or(granted) AS granted, count(*) AS devices,
                   count(*) FILTER (WHERE tx) AS tx, 1 AS licences
            FROM mast JOIN sup USING (holder) GROUP BY ALL)"""


class Tables:
    """The test tables of one folder, and the register tables they stand for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table several parts of one query share, such as the merge."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def clients(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("holder"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("class"), (F.col("c_acctbal") < 0).alias("person"))

    @cached_property
    def licences(self) -> DataFrame:
        """Licences with the holder's class and person flag."""
        orders = self.orders.select(
            F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("holder"),
            (F.col("o_orderstatus") == "F").alias("granted"), F.col("o_orderpriority").alias("service"),
            F.col("o_orderdate").alias("issued"))
        return skew_join(orders, self.clients.drop("name"), "holder")

    @cached_property
    def owners(self) -> DataFrame:
        """Licences with their holder, and nothing else."""
        return self.orders.select(F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("holder"))

    @cached_property
    def devices(self) -> DataFrame:
        line = self.lineitem.select(
            F.col("l_orderkey").alias("licence"), F.col("l_partkey").alias("site"),
            F.col("l_extendedprice").alias("value"), F.col("l_linestatus").alias("direction"),
            F.col("l_shipdate").alias("authorised"))
        return line.withColumn("tx", F.col("direction") == "O")

    @cached_property
    def banded_devices(self) -> DataFrame:
        return PRICE_BANDS.assign(self.devices, "value")

    @cached_property
    def bands(self) -> DataFrame:
        return PRICE_BANDS.frame(self.spark)

    @cached_property
    def mast_devices(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("site"), F.col("l_suppkey").alias("licence"),
                                    (F.col("l_linestatus") == "O").alias("tx"))

    @cached_property
    def mast_licences(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("licence"), F.col("s_suppkey").alias("holder"),
            F.col("s_nationkey").alias("class"), (F.col("s_acctbal") < 0).alias("person"),
            (F.col("s_acctbal") >= 500).alias("granted"))
