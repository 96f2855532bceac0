"""Change feeds (Structured Streaming over RAW) and the ordered run that drives them."""
