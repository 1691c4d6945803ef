"""Training-data operators: extraction, filtering, deduplication, search, scanning, mixing and packing.

Nothing else in the library imports this subpackage.
"""
