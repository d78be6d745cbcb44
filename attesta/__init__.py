"""Text reliability analytics as Spark DataFrame operators."""
