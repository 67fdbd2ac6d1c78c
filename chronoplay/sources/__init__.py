"""Readers and writers: driver tables, imports, feeds, exports."""
