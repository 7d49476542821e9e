"""Event-timeline analytics on Spark: composable DataFrame -> DataFrame operators."""
