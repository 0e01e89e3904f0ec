"""Every query of the engine, by name, with its DuckDB equivalent."""

from __future__ import annotations

from . import edited, markup, structure, trees

QUERIES: dict = {**markup.Q, **trees.Q, **structure.Q, **edited.Q}
ORACLES: dict[str, str] = {**markup.O, **trees.O, **structure.O, **edited.O}
