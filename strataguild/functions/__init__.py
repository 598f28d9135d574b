"""Column expressions: null rules, scalar helpers, classification, seeded integers."""
