"""Training-data operators: formatting, de-duplication, filtering, packing, extraction."""
