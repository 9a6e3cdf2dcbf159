"""Geometry values: their bytes, their texts and what is computed from them."""
