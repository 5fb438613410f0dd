"""sources of the record-sort engine."""
