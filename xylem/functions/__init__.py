"""Column functions with the value rules of XML queries."""
