"""Document-corpus operators on Spark: load, split, retrieve, evaluate, build training rows."""
