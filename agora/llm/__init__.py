"""Training-data operators: deduplication, scoring, tokenising, packing and archiving of text at corpus scale."""
