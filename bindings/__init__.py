"""Queries over the driver tables, each with its SQL counterpart where SQL can say it.

The tables are clean, so every query first writes its values in the messy form an operator expects,
by fixed expressions over whole tables; the SQL side starts from the values before that.
"""

from importlib import import_module

from bindings.registry import ORACLES, QUERIES

for _name in ("cells", "votes", "grids", "files", "describing", "asking", "batching", "running", "scoring"):
    import_module(f"bindings.{_name}")

__all__ = ["ORACLES", "QUERIES"]
