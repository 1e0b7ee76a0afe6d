"""The visual query, and evidence documents made from its results."""
