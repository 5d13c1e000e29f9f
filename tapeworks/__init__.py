"""tapeworks: event-time analytics on Spark, written as DataFrame plans."""
