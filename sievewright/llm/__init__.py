"""Operators for language-model training data: leakage, packing, mixing and cutting of texts."""
