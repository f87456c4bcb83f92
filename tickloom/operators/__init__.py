"""Operators: frames in, frames out, one Catalyst plan each."""
