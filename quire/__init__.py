"""Document-to-report analytics as Spark DataFrame operators."""
