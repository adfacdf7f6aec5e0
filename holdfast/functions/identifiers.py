"""Checksummed identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.text import without_spaces

# The published weights and modulus of the 11-digit business number.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ABN_MODULUS = 89


def weighted_checksum(x: Column, weights: Sequence[int], modulus: int, lead_offset: int = 0) -> Column:
    """Are there exactly len(weights) digits whose weighted sum divides by ``modulus``?

    White space is ignored. ``lead_offset`` is taken off the first digit.
    """
    digits = without_spaces(F.coalesce(x, F.lit("")))
    terms = [(F.substring(digits, i + 1, 1).try_cast("int") - (lead_offset if i == 0 else 0)) * w
             for i, w in enumerate(weights)]
    total = reduce(lambda a, b: a + b, terms)
    well_formed = digits.rlike(f"^[0-9]{{{len(weights)}}}$")
    return F.coalesce(well_formed & (total % modulus == 0), F.lit(False))


def valid_abn(x: Column) -> Column:
    return weighted_checksum(x, ABN_WEIGHTS, ABN_MODULUS, lead_offset=1)
