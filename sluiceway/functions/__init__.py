"""functions of sluiceway."""
