"""Relational operators over nodes, edges, overrides and queues."""
