"""Assembled plans: the whole way of a line, batch and per micro-batch."""
