"""News analytics on Spark: items, stories, digests and the tables made from them."""
