"""Every query of the library by name, with its DuckDB counterpart."""

from __future__ import annotations

from keyloom.queries import commands, keys, sequences, sorted_sets, spatial

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (sorted_sets, keys, sequences, spatial, commands):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
