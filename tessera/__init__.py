"""tessera: a Spark-first analytics engine for evaluation run records and text corpora."""
