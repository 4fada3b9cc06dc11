"""The statement language: text to tree and back."""

from .parser import parse
from .printer import show, show_statement

__all__ = ["parse", "show", "show_statement"]
