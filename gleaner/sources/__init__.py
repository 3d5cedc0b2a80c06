"""Sources of the posting analytics library."""
