"""Deliberately empty: every input is a finite table read once, so nothing here streams."""
