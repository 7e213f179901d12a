"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface (texts, spans, files); ``queries.py`` derives the fixed query
results from them.
"""
