"""Ready-made queries over the TPC-H-like tables and their SQL oracles."""
