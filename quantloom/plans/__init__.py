"""Publication, range runners and the backfill planner."""
