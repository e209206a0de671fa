"""Sports-results analytics on PySpark."""
