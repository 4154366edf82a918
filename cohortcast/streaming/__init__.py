"""Structured Streaming jobs over captures, bets and outcomes."""
