"""Content-based similarity and retrieval analytics as Spark DataFrame operators."""
