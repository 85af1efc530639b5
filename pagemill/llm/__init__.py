"""Training-data operators: mixing, near-duplicates, archives, packing, scans, sharding, privacy, language, search.

Nothing outside this subpackage imports it.
"""
