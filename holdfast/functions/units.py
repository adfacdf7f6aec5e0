"""Values with a unit: text of a number of hertz, and back.

Both work in steps, as columns of their own, so that every step is computed once a row and stays
in generated code; as one expression they would repeat themselves many times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "—"


def _by_size(x: Column, giga, mega, kilo, plain) -> Column:
    return (F.when(x >= 1e9, F.lit(giga)).when(x >= 1e6, F.lit(mega))
            .when(x >= 1e3, F.lit(kilo)).otherwise(F.lit(plain)))


def with_hz_text(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``value`` as text in GHz, MHz, kHz or Hz by size, trailing zeros trimmed.

    A value that is missing or not positive becomes a dash. The decimals are those of the exact
    binary value, half up: formatting the shortest decimal text instead would bring 8.37815 (a
    little less in binary) one too high. So the value times a power of ten is taken without error:
    it is split into halves of 26 bits, whose products are exact, and what rounding lost is added.
    """
    x = F.col(value)
    c = {n: F.col(f"_hz_{n}") for n in ("v", "scale", "places", "product", "spread", "below", "high", "n", "rest")}
    out = df.withColumns({
        "_hz_v": F.when((x > 0) & ~F.isnan(x) & (x < F.lit(1e21)), x / _by_size(x, 1e9, 1e6, 1e3, 1.0)),
        "_hz_scale": _by_size(x, 10 ** 6, 10 ** 4, 10 ** 4, 1), "_hz_places": _by_size(x, 6, 4, 4, 0)})
    out = out.withColumns({"_hz_product": c["v"] * c["scale"], "_hz_spread": c["v"] * F.lit(134217729.0)})
    out = out.withColumns({"_hz_below": F.floor("_hz_product"), "_hz_high": c["spread"] - (c["spread"] - c["v"])})
    lost = (c["high"] * c["scale"] - c["product"]) + (c["v"] - c["high"]) * c["scale"]
    # From 1e21 on the fraction is taken apart first: the number times its scale would not fit a long.
    large = (x >= F.lit(1e21)) & (x < F.lit(float("inf")))
    part = (x / 1e9) % F.lit(1.0)
    millionths = F.floor(part * 1e6 + 0.5)
    giga = ((x / 1e9 - part).try_cast("decimal(38,0)") + F.when(millionths == 10 ** 6, 1).otherwise(0)).cast("string")
    after = F.rtrim(F.lpad((millionths % 10 ** 6).cast("string"), 6, "0"), F.lit("0"))
    huge = F.concat(F.coalesce(giga, (x / 1e9).cast("string")),
                    F.when(after == "", F.lit("")).otherwise(F.concat(F.lit("."), after)), F.lit(" GHz"))
    half = (c["product"] - c["below"].cast("double") - 0.5) + lost >= 0
    out = out.withColumn("_hz_n", c["below"] + F.when(half, 1).otherwise(0))
    out = out.withColumn("_hz_rest", c["n"] % c["scale"])
    whole = ((c["n"] - c["rest"]) / c["scale"]).cast("long").cast("string")
    decimals = F.rtrim(F.lpad(c["rest"].cast("string"), c["places"], F.lit("0")), F.lit("0"))
    text = F.concat(whole, F.when(c["rest"] == 0, F.lit("")).otherwise(F.concat(F.lit("."), decimals)),
                    _by_size(x, " GHz", " MHz", " kHz", " Hz"))
    return out.withColumn(name, F.coalesce(text, F.when(large, huge), F.lit(MISSING))).drop(*[f"_hz_{n}" for n in c])


def with_parsed_hz(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the number of hertz in a typed text; MHz when no unit is given, NULL when not positive."""
    low, number = F.col("_hz_low"), F.col("_hz_number")
    unit = (F.when(low.contains("ghz"), F.lit(1e9))
            .when(low.contains("khz"), F.lit(1e3))
            .when(low.contains("hz") & ~low.contains("mhz") & low.rlike(r"(?<![a-z0-9_])hz(?![a-z0-9_])"), F.lit(1.0))
            .otherwise(F.lit(1e6)))
    out = df.withColumn("_hz_low", F.lower(F.trim(text)))
    digits = F.substring_index(F.regexp_replace(low, r"[^0-9.]+", ""), ".", 2)
    out = out.withColumn("_hz_number", digits.try_cast("double") * unit)
    return out.withColumn(name, F.when(number > 0, number)).drop("_hz_low", "_hz_number")
