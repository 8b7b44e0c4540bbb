"""Time-series storage and query operators expressed as Spark DataFrame plans."""
