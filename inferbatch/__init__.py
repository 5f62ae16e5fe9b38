"""inferbatch: DataFrame and Structured Streaming operators for batch-inference data."""
