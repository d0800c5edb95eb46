"""Training-text operators: quality, deduplication, mixing, extraction, encoding."""
