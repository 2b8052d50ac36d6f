"""Jobs composed of operators: dataset batches and candidate search."""
