"""Analytics and retrieval over vaults of linked notes, written for Spark."""
