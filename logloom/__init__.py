"""Event-log analytics on Spark."""
