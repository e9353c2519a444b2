"""The query builder, its SQL text and its plans."""
