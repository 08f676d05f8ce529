"""Operators for preparing training data: text, pages, conversations and vectors."""
