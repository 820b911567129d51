"""Operators that prepare training text: dedup, decontamination, filters, sharding and packing."""
