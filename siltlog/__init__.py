"""A key/value store whose only truth is an append-only operation log, as DataFrame queries."""
