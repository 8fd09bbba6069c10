"""Operators for the training data of language models."""
