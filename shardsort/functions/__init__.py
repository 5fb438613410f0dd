"""functions of the record-sort engine."""
