"""Training-data operators: dedup, decontamination, classifiers, packing, extraction."""
