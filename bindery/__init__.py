"""Bindery: a PySpark engine for nested publications and the text corpora made of them."""
