"""Scalar functions: rounding, bins, keys, checksums, shapes, units."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.functions import dates, identifiers, numbers, text, units


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def many(spark, column, values, kind):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", column(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("value,places,want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (-0.05, 1, 0.0), (1.25, 1, 1.3), (-33.8675, 3, -33.867)])
def test_half_up_rounds_towards_plus_infinity(spark, value, places, want):
    assert one(spark, lambda x: numbers.half_up(x, places), value, "double") == want


def test_number_has_no_nan_no_blank_no_infinity(spark):
    assert many(spark, numbers.number, ["1.5", "", "x", "NaN", "Infinity", None, " 7 "], "string") == \
        [1.5, None, None, None, None, None, 7.0]


def test_bins_grow_with_the_value_and_stay_on_the_axis(spark):
    values = [2e4, 1e5, 1e6, 1e8, 1e9, 1e10, 1e11]
    bins = many(spark, numbers.log_bin, values, "double")
    assert bins == sorted(set(bins))
    assert many(spark, numbers.log_bin, [1e3, 3e11, 1.953e14, None, float("nan")], "double") == [-1] * 5
    inside = many(spark, numbers.log_bin, [1e4, 4.775e8, 2.9e11], "double")
    assert all(0 <= b < numbers.log_bin_count() for b in inside)
    assert numbers.log_bin_count() == 180


def test_bin_edges_are_a_constant_ratio_apart(spark):
    edges = many(spark, numbers.log_bin_edge, [0, 1, 50, 51, 170, 171], "int")
    for a, b in zip(edges[::2], edges[1::2]):
        assert math.log10(b / a) == pytest.approx(1 / 24, abs=1e-12)


def test_ramp_is_inverted_by_its_breakpoints(spark):
    rows = spark.range(8).select(
        F.col("id").cast("int").alias("i"),
        numbers.ramp_breakpoint(F.col("id"), F.lit(500.0)).alias("v"))
    back = rows.select("i", numbers.ramp_bucket(numbers.log_share(F.col("v"), F.lit(500.0))).alias("b")).collect()
    assert all(r["i"] == r["b"] for r in back)
    assert many(spark, numbers.ramp_bucket, [-1.0, 2.0], "double") == [0, 7]


def spelled_key(name):
    """The rules of the key, letter by letter."""
    if name is None:
        return None
    words = "".join(" AND " if c == "&" else " " if c in text.PUNCTUATION or c.isspace() else c for c in name.upper())
    return " ".join(text.FOLDS.get(w, w) for w in words.split())


def test_name_key_follows_its_rules(spark):
    rng = random.Random(31)
    pieces = ["ltd", "Ltd.", "INCORPORATED", "incorporatedly", "unLTD", "&", "&&", "fern", "O'Dell", "(west)", "quay-side", "n/a", "7", "Ö", ","]
    names = [rng.choice(["", " ", "\t"]).join(rng.choice([" ", "  ", "\u00a0"]) + rng.choice(pieces) for _ in range(rng.randint(0, 6)))
             for _ in range(300)]
    # A fold looks at whole words before punctuation goes, so words run together by a fold are left out.
    names = [n for n in names if not re.search(r"(?i)(ltd|incorporated)[^\W_]|[^\W_](ltd|incorporated)", re.sub(r"(?i)unltd|incorporatedly", "x", n))]
    assert many(spark, text.name_key, [*names, None], "string") == [spelled_key(n) for n in [*names, None]]


def test_a_company_suffix_tells_two_names_apart(spark):
    keys = many(spark, text.name_key, ["Fernquay", "Fernquay Pty", "Fernquay Pty Ltd", "Fernquay Inc"], "string")
    assert len(set(keys)) == 4


def business_number(seed):
    """A valid number: nine digits drawn, the first two found by trying."""
    rest = [random.Random(seed).randint(0, 9) for _ in range(9)]
    for lead in range(10, 100):
        digits = [lead // 10, lead % 10, *rest]
        if ((digits[0] - 1) * 10 + sum(d * w for d, w in zip(digits[1:], identifiers.ABN_WEIGHTS[1:]))) % identifiers.ABN_MODULUS == 0:
            return "".join(map(str, digits))
    return business_number(seed + 1000)


def test_checksum(spark):
    good = [business_number(k) for k in range(20)]
    spaced = [f"{n[:2]} {n[2:5]}\u00a0{n[5:8]} {n[8:]}" for n in good]
    wrong = [n[:k % 11] + str((int(n[k % 11]) + 1) % 10) + n[k % 11 + 1:] for k, n in enumerate(good)]
    odd = [good[0][:-1], good[0] + "0", "x" + good[0][1:], "", " ", None]
    assert many(spark, identifiers.valid_abn, [*good, *spaced, *wrong, *odd], "string") == [True] * 40 + [False] * (20 + len(odd))


def test_personal_shape(spark):
    plain = re.compile(r"[A-Z']{1,15}")

    def shape(key):
        if not key or re.search("[0-9]", key) or set(key.split()) & {"DEPOT", "GUILD"}:
            return False
        parts = [p.split() for p in f" {key} ".split(" AND ")]
        if not all(all(plain.fullmatch(w) for w in p) for p in parts):
            return False
        return 2 <= len(parts[0]) <= 4 if len(parts) == 1 else len(parts) <= 3 and all(1 <= len(p) <= 4 for p in parts)

    rng = random.Random(8)
    words = ["IDA", "W", "QUILL", "FEN", "AND", "DEPOT", "GUILD", "R2", "EXTRAORDINARILYLONG", "FIFTEENLETTERSX", "Ö"]
    keys = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    keys = [k for k in keys if not re.search(r"^AND\b|\bAND$|AND AND", k)] + ["", None]
    assert many(spark, lambda x: text.personal_shape(x, ["DEPOT", "GUILD"]), keys, "string") == [shape(k) for k in keys]


def test_rules_in_order(spark):
    rules = [(text.whole_words(["POLICE"]), "SAFETY"), (text.whole_words(["MINES", "PETROLEUM"]), "MINING"),
             (text.whole_words(["DEPARTMENT OF", "POLICE"]), "GOV")]
    got = many(spark, lambda x: text.first_rule(x, rules, "NONE"),
               ["HILL TOP POLICE", "DEPARTMENT OF MINES", "DEPARTMENT OF PARKS", "POLICEMAN"], "string")
    assert got == ["SAFETY", "MINING", "GOV", "NONE"]


HZ = {7.0: "7 Hz", 7040.0: "7.04 kHz", 137.1e6: "137.1 MHz", 1090e6: "1.09 GHz", 6e3: "6 kHz", 24.00625e9: "24.00625 GHz",
      999.0: "999 Hz", 145612500.0: "145.6125 MHz", 62500.0: "62.5 kHz", 2e21: "2000000000000 GHz", 1.5e24: "1500000000000000 GHz",
      9e20: "900000000000 GHz", 1e21 + 524288: "1000000000000.000488 GHz", 3e30: "3000000000000000000000 GHz"}


def test_hertz_text(spark):
    rows = spark.createDataFrame([(v,) for v in HZ], "x double")
    got = {r["x"]: r["t"] for r in units.with_hz_text(rows, "x", "t").collect()}
    assert got == HZ
    odd = spark.createDataFrame([(None,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert {r["t"] for r in units.with_hz_text(odd, "x", "t").collect()} == {"—"}


def test_hertz_text_keeps_channels_apart(spark):
    rows = spark.range(2000).select((F.lit(477e6) + F.col("id") * 12500).alias("x"))
    shown = units.with_hz_text(rows, "x", "t")
    assert shown.select("t").distinct().count() == 2000


def test_typed_hertz(spark):
    typed = {"477.5": 477.5e6, "11 GHz": 11e9, "530 kHz": 530e3, "9 hz": 9.0, "5 MHz": 5e6, "abc": None, "0": None,
             "1.2.3 ghz": 1.2e9}
    rows = spark.createDataFrame([(t,) for t in typed], "x string")
    assert {r["x"]: r["v"] for r in units.with_parsed_hz(rows, "x", "v").collect()} == typed


def test_dates(spark):
    assert many(spark, lambda x: dates.year_token(dates.to_day(x), "never"), ["2027-03-01", "", None, "n/a", "1962-12-31T00:00"], "string") \
        == ["2027", "never", "never", "never", "1962"]
    assert many(spark, dates.is_year, ["2027", "never", "20271"], "string") == [True, False, False]


def test_ordered_code_and_spaces(spark):
    assert many(spark, lambda x: text.ordered_code(x, ["fine", "fair"]), ["fair", "fine", "poor", None], "string") == [1, 0, 2, 2]
    assert one(spark, text.clean_spaces, " a  b \n c ") == "a b c"
