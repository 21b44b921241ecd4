"""Operators for training-data preparation: near-duplicates, quality, language, packing, tokens, scoring, personal data.

Nothing else in the library imports this subpackage.
"""
