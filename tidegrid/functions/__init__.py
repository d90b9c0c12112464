"""Column expressions: grids, key codecs, labels, digests."""
