"""A PySpark engine that turns transcripts and documents into a queryable store of memories."""
