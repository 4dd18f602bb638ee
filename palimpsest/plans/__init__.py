"""Query plans: the finder, key domains, and what a plan will read."""
