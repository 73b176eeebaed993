"""Stateless stages on streams, and progress rows. An extension: there is no streaming query to match."""
