"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage; remove the folder and
the rest keeps working.
"""
