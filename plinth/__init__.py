"""plinth: building-graph analytics as Spark DataFrame operators."""
