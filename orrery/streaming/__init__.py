"""Incremental variants of the timing operators on streams of events (entity_id, ts)."""
