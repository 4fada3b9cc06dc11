"""The language's expressions as Spark columns."""
