"""Commits as a stream: files that arrive are taken batch by batch."""
