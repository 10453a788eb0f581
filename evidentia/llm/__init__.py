"""Training-data operators: near-dedup, licence scans, token counts, media
columns, archives, sharding, substring dedup, quality, decontamination, packing.

Nothing outside this subpackage imports it.
"""
