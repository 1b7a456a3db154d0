"""Training-data operators: dedup, search, quality, extraction, packing and scans."""
