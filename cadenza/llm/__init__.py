"""Training-data operators: de-duplication, scoring, counting, packing, mixing and search.

Nothing outside this subpackage imports it.
"""
