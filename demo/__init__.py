"""Adapter from the driver tables to the network schema, demo queries and SQL oracles."""

import importlib

_MODULES = ["lookups", "spatial", "rides", "nested", "builds", "transfers", "speech", "calibration"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"demo.{m}")
