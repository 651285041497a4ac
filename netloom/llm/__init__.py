"""Operators for preparing training text, each usable on its own DataFrame."""
