"""Training-data operators: cleaning, deduplication, decontamination, packing and sharding.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
