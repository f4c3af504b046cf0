"""Query plans: operators bound to the tables at hand, each beside the same in ANSI SQL."""
