"""Grouped-forecast analytics on Spark: fields of members per card, as-of evidence, probabilities that sum to one."""
