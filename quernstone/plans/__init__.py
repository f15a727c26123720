"""Query catalogue: each entry pairs a DataFrame plan with its SQL."""
