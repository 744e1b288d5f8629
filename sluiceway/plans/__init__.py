"""plans of sluiceway."""
