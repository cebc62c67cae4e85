"""Intentionally empty.

Nothing in the modelled domain is a stream: builds are yearly snapshots and every run is a batch
over stored tables, so there is no streaming operator to provide.
"""
