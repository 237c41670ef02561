"""Column functions and small byte functions on records and keys."""
