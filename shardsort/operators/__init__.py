"""operators of the record-sort engine."""
