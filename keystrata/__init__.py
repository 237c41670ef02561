"""Analytics over append-only, versioned key/value logs, expressed as Spark plans."""
