"""Record linkage on Spark: normalise, retrieve, compare, decide, evaluate."""
