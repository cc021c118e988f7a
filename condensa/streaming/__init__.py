"""State that outlives a record."""
