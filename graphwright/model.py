"""The property graph: nodes and edges as DataFrames, and the commit log.

nodes: id, label, name, rel_path, module, file_id, functions_count, classes_count, imports_count, methods_count, line_number, params, decorators, bases,
methods, names, import_type; each label fills its own
edges: src, dst, rel_type; unique on all three
commits: sha, author_name, author_email, committed_at, is_merge; from git also message
commit_files: sha, path
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("Repository", "File", "Function", "Class", "Import")
CONTAINS_FILE, CONTAINS_FUNCTION, CONTAINS_CLASS = "REPOSITORY_CONTAINS_FILE", "FILE_CONTAINS_FUNCTION", "FILE_CONTAINS_CLASS"
IMPORTS, INHERITS, CALLS = "FILE_IMPORTS_MODULE", "CLASS_INHERITS_CLASS", "FUNCTION_CALLS_FUNCTION"
RELATIONS = (CONTAINS_FILE, CONTAINS_FUNCTION, CONTAINS_CLASS, IMPORTS, INHERITS, CALLS)
NODE_COLUMNS = {
    "id": "string", "label": "string", "name": "string", "rel_path": "string", "module": "string", "file_id": "string",
    "functions_count": "long", "classes_count": "long", "imports_count": "long", "methods_count": "long", "line_number": "long",
    "params": "array<string>", "decorators": "array<string>", "bases": "array<string>", "methods": "array<string>", "names": "array<string>", "import_type": "string",
}


def as_nodes(df: DataFrame, label: str) -> DataFrame:
    """The node columns; those that df lacks are null."""
    return df.select(*((F.lit(label) if c == "label" else F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in NODE_COLUMNS.items()))


@dataclass
class Graph:
    """Parts are built on demand, so a query scans only the labels and relations that it names."""

    node_parts: dict[str, Callable[[], DataFrame]]
    edge_parts: dict[str, Callable[[], DataFrame]]
    commits: Callable[[], DataFrame] | None = None
    commit_files: Callable[[], DataFrame] | None = None
    tables: Callable[[str], DataFrame] | None = None
    ends: dict[str, tuple[str, str]] | None = None  # labels at the ends of each relation, where a source vouches for them: walks then leave out relations that can't be on them
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def _part(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def nodes(self, *labels: str) -> DataFrame:
        return _union(as_nodes(self._part(x, self.node_parts[x]), x) for x in labels or LABELS)

    def edges(self, *relations: str) -> DataFrame:
        return _union(self._part(x, self.edge_parts[x]).select("src", "dst", F.lit(x).alias("rel_type")) for x in relations or RELATIONS)

    def leading(self, label: str, back: bool = False) -> tuple[str, ...]:
        """Relations that can be on a walk of one or two directed steps to a label, or back from it."""
        if self.ends is None:
            return RELATIONS
        src, dst = (1, 0) if back else (0, 1)
        last = {r for r, x in self.ends.items() if x[dst] == label}
        before = {r for r, x in self.ends.items() if x[dst] in {self.ends[y][src] for y in last}}
        return tuple(r for r in RELATIONS if r in last | before) or RELATIONS

    def labels(self, relations: Iterable[str]) -> tuple[str, ...]:
        """Labels that relations join."""
        return LABELS if self.ends is None else tuple(x for x in LABELS if any(x in self.ends[r] for r in relations))

    def beside(self, label: str, *others: str) -> tuple[str, ...]:
        """Relations that can join a label with one of others, in either direction."""
        if self.ends is None:
            return RELATIONS
        return tuple(r for r in RELATIONS if r in self.ends and any(set(self.ends[r]) == {label, x} for x in others)) or RELATIONS

    def circular(self) -> tuple[str, ...]:
        """Relations that can be on a closed undirected trail of two or three steps."""
        if self.ends is None:
            return RELATIONS
        links = [frozenset(x) for x in self.ends.values()]
        beside = lambda x: {y for link in links if x in link for y in (link - {x} or link)}
        return tuple(r for r in RELATIONS if r in self.ends and (links.count(frozenset(self.ends[r])) > 1 or len(set(self.ends[r])) == 1 or beside(self.ends[r][0]) & beside(self.ends[r][1]))) or RELATIONS

    def joined(self, start: str, end: str, *relations: str) -> bool:
        """Whether one or two undirected steps over these relations can lead from one label to another."""
        if self.ends is None:
            return True
        links = [frozenset(self.ends[r]) for r in relations]
        beside = lambda x: {y for link in links if x in link for y in (link - {x} or link)}
        return end in beside(start) or bool(beside(start) & beside(end))

    def sql(self, statement: str, args: dict[str, object] | None = None) -> DataFrame:
        """A statement of Spark SQL over {nodes} and {edges}, with named parameters (:name) from args."""
        nodes, edges = self.nodes(), self.edges()
        return nodes.sparkSession.sql(statement, args=args or {}, nodes=nodes, edges=edges)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph from two tables, such as those that sinks.tables wrote."""
        return cls({x: lambda x=x: nodes.filter(F.col("label") == x) for x in LABELS}, {x: lambda x=x: edges.filter(F.col("rel_type") == x) for x in RELATIONS})


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
