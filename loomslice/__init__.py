"""Slices of relational data that keep references whole, and scrubbing of what they hold, on Spark."""
