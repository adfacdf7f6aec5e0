"""holdfast: register analytics written as Spark DataFrame operators."""
