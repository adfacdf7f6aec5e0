"""Session helpers: a local session for tests and benches, SQL settings worth having."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings every operator is happy with. They are SQL settings only, so
# they can be applied to a session somebody else created.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(app: str = "holdfast", cpus: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session. On a cluster, use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
