"""Column functions; all stay inside Catalyst expressions."""
