"""Training-data operators: archives, duplicates, mixing, language, quality, packing."""
