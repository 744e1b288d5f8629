"""sources of sluiceway."""
