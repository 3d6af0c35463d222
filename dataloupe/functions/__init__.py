"""Column-level building blocks: type tests, safe column access, shared expressions."""
