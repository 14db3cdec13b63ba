"""Structured Streaming jobs: batch operators per micro-batch, and keyed state."""
