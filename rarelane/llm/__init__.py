"""Operators that prepare training text: output, packing, de-duplication, filters, scoring, search."""
