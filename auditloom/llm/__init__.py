"""Training-data operators: packing, deduplication, scoring, extraction and scans over document tables."""
