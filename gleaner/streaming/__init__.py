"""Streaming of the posting analytics library."""
