"""Operators for training data: run collapsing, percentile summaries, tokenizing, leak search, reading level."""
