"""Names, ordinals and limits of the data model. They are part of the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL_KINDS = ("file", "class", "interface", "enum", "record", "annotation", "method", "constructor", "field", "function", "variable", "type_alias", "test")
TYPE_KINDS = ("class", "interface", "enum", "record", "annotation", "type_alias")
CALLABLE_KINDS = ("method", "constructor", "function")
EDGE_KINDS = ("CONTAINS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "CALLS", "INSTANTIATES", "REFERENCES", "TESTS")
EVIDENCE = ("RESOLVED_EXACT", "COVERAGE_OBSERVED", "STATIC_INFERRED", "HISTORY_COCHANGE", "NAMING_HEURISTIC")
#: Edges that carry no impact; edges that are no architecture dependency.
SILENT_KINDS, STRUCTURAL_KINDS = ("CONTAINS", "IMPORTS"), ("CONTAINS", "TESTS")
MAX_DEPTH, MAX_IMPACTED = 6, 5000
PATH_DEPTH, PATH_VISITED = 8, 50_000
#: Symbols that a test's search for a critical one sees; ancestors that a commit may have.
CRITICAL_SEEN, MOST_COMMITS = 5000, 1_000_000
#: Report lists: nodes of a slice; violations, API changes and owners; pairs of modules.
SLICE_NODES, LIST_CAP, COUPLING_CAP = 400, 500, 100
#: Edge columns in the order in which edges compare.
EDGE_ORDER = ("f", "t", "kind_ord", "ev_ord", "file", "line", "rule")


def ordinal(column: str, names: tuple[str, ...]) -> Column:
    """The place of a name in its declaration, from 0; the last for an unknown name."""
    out = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        out = F.when(F.col(column) == name, F.lit(i)).otherwise(out)
    return out.cast("int")


def evidence_name(strength: str) -> Column:
    return F.element_at(F.array(*map(F.lit, EVIDENCE)), (6 - F.col(strength)).cast("int"))
