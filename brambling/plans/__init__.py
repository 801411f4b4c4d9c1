"""Query catalogues: a Spark plan and, where SQL can say it, the same query for a second engine."""
