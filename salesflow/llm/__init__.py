"""Operators for text corpora: archives, lists, near and exact duplicates, quality, tokens and mixing."""
