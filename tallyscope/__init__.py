"""Public-works audit analytics as Spark DataFrame functions."""
