"""Files as rows: listing, format readers and conversion."""
