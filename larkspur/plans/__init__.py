"""Named queries over the stored tables."""
