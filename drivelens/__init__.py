"""Analytics of recorded drives, written for Spark."""
