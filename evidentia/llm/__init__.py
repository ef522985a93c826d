"""Training-data operators: packing, extraction, formatting, search, joins, tokenising, scans, scoring and line dedup."""
