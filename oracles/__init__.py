"""DuckDB SQL for the queries, by name."""

from oracles.decisions import O as _DECISIONS
from oracles.drawing import O as _DRAWING
from oracles.indicators import O as _INDICATORS
from oracles.patterns import O as _PATTERNS

ORACLES: dict[str, str] = {**_INDICATORS, **_PATTERNS, **_DECISIONS, **_DRAWING}
