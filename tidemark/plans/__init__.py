"""Helpers that shape physical plans: session settings, checkpoints, task counts."""
