"""Operators for preparing training data: dedup, language ID, extraction, tokens, mixing."""
