"""Training-data operators: dedup, decontamination, scoring, classification, mixing and sharding."""
