"""Operators for large text corpora: filters, scoring, sampling, sharding, joins, search and tokenizers.

Nothing outside this subpackage imports it.
"""
