"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package (but for the guarded import in ``__spark_entry__``) uses it.
"""
