"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
