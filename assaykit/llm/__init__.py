"""Operators on text corpora: fingerprints, scans, classifiers, dedup, mixing, packing, archives.

Nothing else in the library imports this subpackage. Operators take and return DataFrames and
keep columns they do not know; ``queries`` registers one query per operator.
"""
