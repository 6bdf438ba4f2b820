"""Branch-versioned relational analytics on PySpark."""
