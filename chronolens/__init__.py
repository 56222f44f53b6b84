"""Point-in-time time-series analytics expressed as Spark DataFrame plans."""
