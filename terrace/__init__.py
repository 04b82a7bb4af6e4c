"""Season feature jobs on Spark: rating, match and price tables to look-ahead-free features and reports."""
