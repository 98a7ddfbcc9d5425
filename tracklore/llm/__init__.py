"""Training-data operators: filtering, de-duplication, search, mixing and sharding of text tables."""
