"""Relational operators of the near-duplicate engine."""
