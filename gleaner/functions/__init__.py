"""Functions of the posting analytics library."""
