"""Rules as SQL expressions, and their columns."""
