"""DataFrame operators: filters, fields, comparisons, profiles, selections and intervals."""
