"""Operators for building language-model training corpora at scale."""
