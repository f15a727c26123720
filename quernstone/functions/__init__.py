"""Column helpers that stay inside generated code."""
