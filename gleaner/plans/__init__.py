"""Plans of the posting analytics library."""
