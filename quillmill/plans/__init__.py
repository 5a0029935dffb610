"""Sessions, durable cut points and whole pipelines."""
