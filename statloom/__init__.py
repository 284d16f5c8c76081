"""Statistical analytics as Spark DataFrame operators."""
