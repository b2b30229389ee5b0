"""Readers that turn raw log files into the ``events`` DataFrame."""
