"""All registered queries: key -> (spark callable, oracle SQL or None)."""

from __future__ import annotations

from . import keys_quality, keys_rules, keys_stats

REGISTRY: dict = {}
for _mod in (keys_stats, keys_quality, keys_rules):
    REGISTRY.update(_mod.Q)
