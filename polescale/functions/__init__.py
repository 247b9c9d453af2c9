"""Column expressions; nothing here runs a query."""
