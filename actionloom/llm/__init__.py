"""Operators for training-data pipelines: texts, tokens, vectors and transcripts."""
