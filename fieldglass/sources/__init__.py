"""Tables in: CSV, Parquet, frames in memory, synthetic data, and session manifests."""
