"""Operators on texts: pieces, visible forms, token ids, containers, abusive passages."""
