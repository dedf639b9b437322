"""Encoders, comparators and their registry."""

from . import comparators, encoders  # noqa: F401  (they register themselves)
from .registry import Algorithm, algorithms, comparator, encoder, load_plugins, register

__all__ = ["Algorithm", "algorithms", "comparator", "encoder", "load_plugins", "register"]
