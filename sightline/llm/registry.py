"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("warc", "suffixes", "quality", "packing", "urls", "neighbours", "decontaminate", "jaccard", "licenses", "tokens", "resampling", "mixing")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
