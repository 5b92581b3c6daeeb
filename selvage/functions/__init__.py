"""Column expressions: names, sets, intervals, digests."""
