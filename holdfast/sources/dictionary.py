"""A JSON object as a two-column table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, class string"


def read_dictionary(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(key, class) rows of a JSON object of texts; an empty table when an optional file is absent."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], SCHEMA)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "class"))
