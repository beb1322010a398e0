"""Registered queries: for each operator a Spark query and, where it exists, its SQL twin."""

from __future__ import annotations

from checks import counters, dyadic, evaluation, exact, linear, sources, streams

FAMILIES = (exact, sources, linear, dyadic, counters, evaluation, streams)


def all_checks() -> dict:
    found = {}
    for family in FAMILIES:
        for name, entry in family.CHECKS.items():
            if name in found:
                raise ValueError(f"{name} is registered twice")
            found[name] = entry
    return found
