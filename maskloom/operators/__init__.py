"""DataFrame operators: filters, windows, splits, masking, memory, metrics, scoring, learners."""
