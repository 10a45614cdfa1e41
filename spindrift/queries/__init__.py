"""Driver-facing queries over the test tables, with oracle SQL."""
