"""Training-data operators: tokens, packing, deduplication, scoring, rules and scans over document tables."""
