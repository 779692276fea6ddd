"""Document analytics on Spark: parse, query and render large document collections."""
