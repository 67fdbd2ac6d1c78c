"""Named query plans and their SQL twins."""
