"""An engine for append-only event logs on Spark."""
