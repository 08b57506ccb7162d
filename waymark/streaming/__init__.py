"""Streaming forms of gap splitting and hourly density."""
