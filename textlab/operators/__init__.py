"""DataFrame operators: labelled tables, counts, splits, vectors, metrics, logs."""
