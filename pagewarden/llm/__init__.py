"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only if it can be imported.
"""
