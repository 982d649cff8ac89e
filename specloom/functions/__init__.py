"""Column builders and small numeric helpers."""
