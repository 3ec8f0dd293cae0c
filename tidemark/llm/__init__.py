"""Operators for training corpora and record matching. Nothing outside this folder imports it."""
