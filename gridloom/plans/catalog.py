"""All queries by name, and their SQL."""

from __future__ import annotations

from . import choose, flow, space

QUERIES = {**choose.QUERIES, **space.QUERIES, **flow.QUERIES}
ORACLES = {**choose.ORACLES, **space.ORACLES, **flow.ORACLES}
