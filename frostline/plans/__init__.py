"""Registered queries: importing this package fills the registry."""

from . import cases, condition, decide, fleet, guidance, learning, records, reroute, service, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
