"""End-to-end plans and the named queries over the shared tables."""
