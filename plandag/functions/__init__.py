"""Token lists and predicate lists compiled to native Columns."""
