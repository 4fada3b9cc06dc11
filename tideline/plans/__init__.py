"""Binding, running and explaining statements."""
