"""Relational operators over a play library."""
