"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from . import chat, code, codebase, diagrams, files, history, intake, parsing, paths, structure, telemetry, upkeep

_PARTS = [history, files, chat, telemetry, code, structure, paths, codebase, intake, diagrams, upkeep, parsing]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
