"""Training-data operators: scoring, filtering, sharding, deduplication, packing.

Everything here is optional for the rest of the library: no module outside
this folder imports it.  Operators take and return DataFrames; the thin
queries with the fixed result shapes are in :mod:`queries`.
"""
