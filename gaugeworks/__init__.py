"""Station observations as Spark jobs: land, flatten, convert, store, query, verify."""
