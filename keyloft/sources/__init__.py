"""Snapshots and command sources."""
