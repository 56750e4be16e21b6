"""Training-data operators: deduplication, scoring, packing, counting, search and decontamination."""
