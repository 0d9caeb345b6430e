"""All registered queries of the visit-planning operators: name -> (Spark function, SQL twin or None)."""

from __future__ import annotations

import functools
import importlib

from homeround.sources.domain import view, with_views

MODULES = ("intake_geocoding", "zoning_planning", "routing_history", "streams_files")


def _entries() -> dict:
    out = {}
    for m in MODULES:
        try:
            out |= importlib.import_module(f"homeround.plans.{m}").QUERIES
        except ModuleNotFoundError as e:
            if e.name != f"homeround.plans.{m}":
                raise
    return out


ENTRIES = _entries()
QUERIES = {name: (lambda spark, sf_dir, f=f: f(functools.partial(view, spark, sf_dir))) for name, (f, _) in ENTRIES.items()}
ORACLE_SQL = {name: with_views(sql) for name, (_, sql) in ENTRIES.items() if sql}
