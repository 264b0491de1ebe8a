"""Outputs: logs, keyed items, routed files and objects."""
