"""Training-data operators: license scans, sharding, near-duplicates, packing and the like.

Nothing outside this subpackage imports it.
"""
