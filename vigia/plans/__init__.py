"""Monthly pipelines composed from operators, and the query registry."""
