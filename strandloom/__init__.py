"""Short-read sequence analytics as Spark DataFrame operators."""
