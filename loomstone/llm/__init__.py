"""Training-data operators: deduplication, sharding, decontamination, scoring, mixing and archives."""
