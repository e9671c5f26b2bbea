"""Part of the catalog analytics engine."""
