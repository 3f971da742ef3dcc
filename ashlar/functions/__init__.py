"""Column functions: text, routing, scoring."""
