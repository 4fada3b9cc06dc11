"""Spark operators of the engine: window aggregates, cohorts, labels, contexts and rewrites."""
