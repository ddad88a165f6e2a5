"""Training-data operators: packing, joins, scans, filters, search, extraction."""
