"""Column helpers: analysis rules and numeric expressions."""
