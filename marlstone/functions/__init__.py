"""Types, literals, casts and comparison tokens."""
