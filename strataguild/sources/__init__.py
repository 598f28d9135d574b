"""Reading and writing tables, and small dimension tables."""
