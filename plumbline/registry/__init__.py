"""The registered queries, by area, each with its SQL twin where one can be written."""

import importlib

AREA_NAMES = ["profile", "shaping", "generation", "comparison", "papers", "training", "records", "services", "files", "timeline"]
AREAS = {name: importlib.import_module(f"plumbline.registry.{name}") for name in AREA_NAMES}


def all_queries() -> dict:
    return {k: v for area in AREAS.values() for k, v in area.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for area in AREAS.values() for k, v in area.ORACLE.items()}
