"""Code-intelligence analytics on Spark: every capability is a DataFrame plan."""
