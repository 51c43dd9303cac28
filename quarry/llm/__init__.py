"""Training-data pipeline operators (dedup, filters, scans, mixing, search)."""
