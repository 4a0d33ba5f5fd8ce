"""Operators for preparing large-scale training corpora; nothing outside this package imports it."""
