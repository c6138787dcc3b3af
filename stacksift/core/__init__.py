"""Session, table access and helpers that every other module may use."""
