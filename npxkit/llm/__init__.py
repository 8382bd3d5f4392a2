"""Training-data operators: licence scans, deduplication, mixing, fingerprints, classifiers,
packing and sharding of text corpora. Nothing else in the library imports this subpackage.
"""
