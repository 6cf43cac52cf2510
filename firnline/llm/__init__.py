"""Operators of a training-data pipeline: packing, search, tokens, fingerprints, classifiers, joins, extraction and scans.

Nothing outside this subpackage imports it.
"""
