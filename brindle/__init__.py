"""Analytics operators written as Spark DataFrame and Structured Streaming code."""
