"""Column expressions: text, lexicon matching, labels and scores."""
