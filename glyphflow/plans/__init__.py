"""Plan choice and the query catalogue."""
