"""DataFrame operators. Keys are long: (model_id, source, source_ord, pos)."""
