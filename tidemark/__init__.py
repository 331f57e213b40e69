"""tidemark: point-in-time research analytics as Spark DataFrame operators."""
