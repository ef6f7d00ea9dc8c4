"""Entity-keyed, frame-indexed analytics on PySpark."""
