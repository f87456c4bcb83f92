"""Readers of the tables and the bar adapter."""
