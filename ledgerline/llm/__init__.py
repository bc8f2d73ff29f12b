"""Training-data operators: counting, mixing, deduplication, filtering and scoring of documents."""
