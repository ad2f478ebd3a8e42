"""Feature layers over unbounded logs."""
