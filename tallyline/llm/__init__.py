"""Training-data operators: tokens, duplicates, leaks, PII, toxicity, pages, search, chat."""
