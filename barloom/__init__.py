"""Market-structure analytics over tables of OHLCV bars, as Spark jobs."""
