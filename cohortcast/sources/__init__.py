"""Reading messy sources and writing idempotent tables."""
