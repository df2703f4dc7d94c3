"""Corpus operators for training-data preparation.

Nothing else in the library imports this subpackage.  Every operator is a plain
function ``DataFrame -> DataFrame``; ``registry`` holds the thin contract queries.
"""
