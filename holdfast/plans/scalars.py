"""Queries that put the scalar functions through whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_up, log_position
from holdfast.functions.units import with_hz_text, with_parsed_hz
from holdfast.plans.registry import Tables, query

# A price times 10^0 to 10^7 covers every unit.
HZ = "l_extendedprice * pow(10, l_linenumber)"
# printf rounds an exact tie to even where half up is wanted: {tie} marks those values.
TRIM = ("regexp_replace(regexp_replace(printf('%.{p}f', hz / {d} + CASE WHEN {tie} THEN 1e-8 ELSE 0 END),"
        " '0+$', ''), '\\.$', '') || ' {u}'")
GHZ = TRIM.format(p=6, d='1e9', u='GHz', tie='hz % 15625000 = 7812500')
MHZ = TRIM.format(p=4, d='1e6', u='MHz', tie='hz % 62500 = 31250')
KHZ = TRIM.format(p=4, d='1e3', u='kHz', tie='false')


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, floor({HZ}) AS hz FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN hz <= 0 THEN '—' WHEN hz >= 1e9 THEN {GHZ}
 WHEN hz >= 1e6 THEN {MHZ} WHEN hz >= 1e3 THEN {KHZ}
 ELSE printf('%.0f', hz) || ' Hz' END AS shown FROM h""")
def format_value(t: Tables) -> DataFrame:
    """A value in the unit of its size, trailing zeros trimmed."""
    hz = F.floor(F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber"))).cast("double")
    values = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", hz.alias("hz"))
    return with_hz_text(values, "hz", "shown").drop("hz")


@query("""WITH x AS (SELECT event_id, value, CASE event_type WHEN 'click' THEN 1e0 WHEN 'view' THEN 1e3
 WHEN 'signup' THEN 1e9 ELSE 1e6 END AS unit FROM events)
SELECT event_id, value * unit AS hz FROM x WHERE value > 0""")
def parse_value(t: Tables) -> DataFrame:
    """Typed text with a unit back to a number."""
    unit = (F.when(F.col("event_type") == "click", " Hz").when(F.col("event_type") == "view", "khz")
            .when(F.col("event_type") == "signup", " GHz").when(F.col("event_type") == "error", " MHz").otherwise(""))
    typed = t.events.select("event_id", F.concat(F.col("value").cast("decimal(20,2)").cast("string"), unit).alias("typed"))
    return with_parsed_hz(typed, "typed", "hz").drop("typed").filter("hz is not null")


@query("""SELECT event_id, floor((log10(value) - log10(0.01)) / (log10(1000.0) - log10(0.01)) * 1e6 + 0.5) / 1e6 AS position
FROM events WHERE value > 0""")
def axis_position(t: Tables) -> DataFrame:
    """Position of a value on a log axis."""
    return t.events.filter("value > 0").select(
        "event_id", half_up(log_position(F.col("value"), 0.01, 1000.0), 6).alias("position"))


@query("""WITH e AS (SELECT vec_id, d::INTEGER AS dimension, CASE WHEN (vec_id + d) % 16 <> 5 THEN embedding[d]::DOUBLE END AS x
  FROM embeddings, generate_series(1, len(embedding)) AS g(d))
SELECT vec_id, dimension, floor(x * 1000 + 0.5) / 1000 AS rounded, CAST(floor(x * 100) + 1 AS DOUBLE) AS tie FROM e""")
def half_up_rounding(t: Tables) -> DataFrame:
    """Half-up rounding of every component, of exact halves on both sides of zero, and of missing values."""
    each = t.embeddings.select("vec_id", F.posexplode("embedding").alias("_at", "_v"))
    x = F.when((F.col("vec_id") + F.col("_at") + 1) % 16 != 5, F.col("_v").cast("double"))
    return each.select("vec_id", (F.col("_at") + 1).alias("dimension"), half_up(x, 3).alias("rounded"),
                       half_up(F.floor(x * 100) + F.lit(0.5)).alias("tie"))
