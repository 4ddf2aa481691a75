"""Point-in-time analytics on Spark: every read is bound to an instant."""
