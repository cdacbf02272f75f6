"""Operators for preparing large text corpora: sketches, duplicates, contamination, labels, secrets, chat and mixing."""
