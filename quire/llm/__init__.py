"""Training-data operators: filters, deduplication, packing and scans over document tables."""
