"""Daily market data and news analytics as Spark DataFrame jobs."""
