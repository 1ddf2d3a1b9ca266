"""Column-level functions: no shuffle, safe to use inside any select."""
