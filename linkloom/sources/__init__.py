"""Readers for the tables of the link graph."""
