"""spanlake: temporal evidence retrieval and corpus preparation as Spark DataFrame operators."""
