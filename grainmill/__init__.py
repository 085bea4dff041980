"""Cleaning, standardising, deduplicating, reconciling and scrubbing tables on Spark."""
