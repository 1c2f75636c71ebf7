"""Operators for texts and records used to train language models, with their queries and SQL."""
