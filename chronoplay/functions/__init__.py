"""Column functions: periods, text folding, ids."""
