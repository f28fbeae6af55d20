"""Training-data operators: search, filtering, deduplication, scoring, tokenizing and mixing."""
