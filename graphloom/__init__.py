"""Property-graph, text, history and event analytics on PySpark."""
