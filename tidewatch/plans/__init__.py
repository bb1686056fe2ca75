"""Named queries and their SQL; each module adds its own to the registry."""

from . import registry
from . import detection, marts, models, profiling, streams, windows  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
