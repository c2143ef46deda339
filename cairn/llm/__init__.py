"""Operators for large-scale text corpora: near duplicates, tokens, languages, personal data, quality, mixing.

Nothing outside this subpackage imports it.
"""
