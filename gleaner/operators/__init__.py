"""Operators of the posting analytics library."""
