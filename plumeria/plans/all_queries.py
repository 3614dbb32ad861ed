"""Imports every module that registers queries."""

from . import catalog, requests, tensors, texts  # noqa: F401
from . import by_operators  # noqa: E402, F401  needs the oracles of the others
