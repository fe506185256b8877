"""axisloom: a Spark-first engine for association analysis of 1-D interval sets."""
