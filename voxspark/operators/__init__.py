"""Operators on tables of words, phrases, segments and embeddings."""
