"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries where it is
present.
"""
