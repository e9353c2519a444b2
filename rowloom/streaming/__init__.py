"""Results row by row and batch by batch."""
