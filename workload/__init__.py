"""Queries, oracles and the rendered log corpus used by the driver contract, bench and tests."""
