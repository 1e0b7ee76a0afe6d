"""Column builders: cells, bins, hashes, encodings and axis arithmetic."""
