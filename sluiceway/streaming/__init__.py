"""streaming of sluiceway."""
