"""Incremental forms of batch operators (an addition; the batch operators are the reference point)."""
