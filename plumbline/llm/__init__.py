"""Operators of a training-data pipeline: scoring, identification, fingerprints, joins, mixing, packing.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
