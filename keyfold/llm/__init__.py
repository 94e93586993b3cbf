"""Operators for large training-data pipelines (toxicity, sharding, nearest
neighbours, language id, token files, url filters, decontamination, personal
data, near-duplicates, source mixing, fill-in-the-middle, exact duplicates,
Merkle manifests). Nothing else in the library imports
this subpackage."""
