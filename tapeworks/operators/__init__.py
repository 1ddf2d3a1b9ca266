"""DataFrame operators: windows, joins and aggregations."""
