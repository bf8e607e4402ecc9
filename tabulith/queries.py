"""All registered queries of the engine's own operators."""

from tabulith.plans import cells, evaluation, extras, filters, fragments, linking, models, references, scalars, search, sources, streams  # noqa: F401
from tabulith.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
