"""Thing Description analytics on Spark: documents, quads, graph patterns, validation, change streams."""
