"""operators of sluiceway."""
