"""plans of the record-sort engine."""
