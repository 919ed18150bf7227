"""Header-aware tabular toolkit whose operators are lazy Spark DataFrame transformations."""
