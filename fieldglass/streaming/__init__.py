"""Streaming form of additive fields."""
