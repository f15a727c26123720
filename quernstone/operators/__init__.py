"""Relational operators: versions, as-of attachment, ratios, cohorts, rankings."""
