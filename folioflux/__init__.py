"""folioflux: document analytics on Spark: clean, segment, store, search, rank, answer."""
