"""Plans built from flows: the query catalogue and the incremental update plan."""
