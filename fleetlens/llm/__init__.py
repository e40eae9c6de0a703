"""Operators for preparing language-model training data.

Nothing else in the library imports this package; the driver entry adds its
queries only when it is present.
"""
