"""Named queries over a data directory and, where SQL can say the same, their SQL."""
