"""Training-data operators: token counts, scoring, near duplicates, sharding.

Nothing outside this subpackage imports it.
"""
