"""The tables an operator works on.

Questions run on an ingested catalogue, not on raw inputs: a table is derived once, written
to the shared folder, and read back from there. Plans stay small, filters reach the Parquet
scan, and Spark knows the real table sizes. That includes the analysed graph: internal edges,
vertices with their degrees, the members of all cycles, and the graph in numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stowage.operators import graph, reachability
from stowage.plans import derived
from stowage.session import configure, fit_partitions, kept_buckets, store_partitioned, working_folder
from stowage.sources import results


# Tables that come from other tables of the catalogue.
GRAPH = {
    "nodes": lambda cat: graph.analysed(cat.assets, cat.edges),
    "pointed": lambda cat: cat.pointed_vertices if cat.is_stored("nodes") else graph.pointed_at(cat.references),
    "starts": lambda cat: graph.starts(cat.assets, cat.references, cat.pointed),
    # Members of all cycles, those with per-actor files included.
    "members": lambda cat: graph.strong_components(cat.references, pointed=cat.pointed),
    # The graph in numbers, vertex by vertex and component by component.
    "named": lambda cat: reachability.number(cat.nodes, cat.members),
    "arcs": lambda cat: reachability.number_links(cat.edges, cat.named),
    "bridges": lambda cat: reachability.bridges(cat.arcs),
    "ids": lambda cat: reachability.mark(cat.named, cat.arcs),
    # The same by hashes of paths.
    "hashed_ids": lambda cat: reachability.hashed_ids(cat.nodes, cat.members, cat.edges),
    "hashed_arcs": lambda cat: reachability.hashed_arcs(cat.edges, cat.members),
}
# Tables that are a filter or a selection of stored ones, and are not stored again.
SEEN = {
    "edges": lambda cat: graph.internal_edges(cat.deps),
    "links": lambda cat: reachability.links(cat.arcs),
    "dag": lambda cat: reachability.condense(cat.arcs, cat.bridges),
}
# References are stored by where they start: what asks for an asset's own references, or compares two
# states of them, does not shuffle them.
LAID_OUT = {"deps": ("from_path", "to_path"), "prev_deps": ("from_path", "to_path")}


class Catalogue:
    def __init__(self, spark: SparkSession, source: str | None, store: str):
        """Tables are read from `store`; with a `source`, missing ones are derived from it first."""
        self._spark = configure(spark)
        self._source = source
        self._store = store.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._saved: set[str] = set()
        self._hashed: reachability.Index | None = None

    @classmethod
    def derive(cls, spark: SparkSession, source: str) -> "Catalogue":
        """A new catalogue over raw tables, kept in the folder of the session's checkpoints."""
        store = f"{working_folder(spark)}/catalogue-{uuid.uuid4().hex}"
        return cls(spark, source, store)

    def reopen(self) -> "Catalogue":
        """The same stored tables without anything computed from them."""
        other = Catalogue(self._spark, self._source, self._store)
        other._tables, other._saved = self._tables, self._saved
        return other

    def table(self, view: str) -> DataFrame:
        if view not in self._tables:
            self._tables[view] = self._open(view)
        return self._tables[view]

    def unstored(self, view: str) -> DataFrame:
        """A table for checks that may be off: as stored if it is, else derived only if it is read."""
        if self.is_stored(view):
            return self.table(view)
        if view == "edges":
            return graph.internal_edges(self.unstored("deps"))
        return derived.load(self._spark, self._source, view)

    def is_stored(self, view: str) -> bool:
        return view in self._tables or self._source is None

    @property
    def references(self) -> DataFrame:
        """Edges for those who ask which there are and not how many: as stored if they are, else off the given tables.

        What reads one end of them then does not carry the paths of both ends through a shuffle.
        """
        return self.edges if self.is_stored("deps") else graph.internal_edges(self._derived("raw_deps"))

    @property
    def unreferenced_or_all(self) -> DataFrame:
        """Vertices for those who ask which of them nothing points at: all, if they are stored."""
        return self.nodes if self.is_stored("nodes") else self.starts

    @property
    def pointed_vertices(self) -> DataFrame:
        """Ends of edges off stored vertices, which know how many lead to them."""
        return self.nodes.where("in_degree > 0").select("asset_path").distinct()

    @property
    def index(self) -> reachability.Index:
        return reachability.Index(self.ids, self.links, self.dag)

    @property
    def hashed(self) -> reachability.Index:
        """The graph for walks that do not ask for the order of paths: by hashes, or in numbers if hashes do not tell all vertices apart."""
        if self._hashed is None:
            if self._source is not None and reachability.tells_apart(self.nodes):
                self._hashed = reachability.hashed(self.hashed_ids, self.hashed_arcs, self.edges)
            else:
                self._hashed = self.index
        return self._hashed

    def saved_violations(self, name: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A state's violations, saved on first use and then read from the store."""
        folder = f"{self._store}/baselines/{name}"
        if folder not in self._saved:
            results.save_violations(found, folder)
            self._saved.add(folder)
        return results.load_violations(self._spark, folder)

    def _open(self, view: str) -> DataFrame:
        path = f"{self._store}/{view}"
        if view in SEEN:
            return SEEN[view](self)
        if self._source is None:
            return self._spark.read.parquet(path)
        if view in LAID_OUT:
            parts = self._partitions()
            rows = self._laid_out(view, parts)
            with kept_buckets(self._spark):
                return store_partitioned(rows, path, parts, "from_path", order=LAID_OUT[view])
        rows = GRAPH[view](self) if view in GRAPH else self._derived(view)
        rows.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(rows.schema).parquet(path)

    def _partitions(self) -> int:
        return fit_partitions(self._spark, *(f"{self._source}/{table}.parquet" for table in derived.BASE_TABLES))

    def _derived(self, view: str) -> DataFrame:
        self._partitions()
        stored = {name: self.table(name) for name in derived.stored_parts(view)}
        return derived.load(self._spark, self._source, view, stored)

    def _laid_out(self, view: str, parts: int) -> DataFrame:
        if view != "deps":
            return self._derived(view)  # in the buckets of `deps`, but for a few rows
        # Grouped where they are to be stored: references are shuffled once.
        raw = self._derived("raw_deps").repartition(parts, "from_path")
        return derived.load(self._spark, self._source, view, {"raw_deps": raw})

    def __getattr__(self, view: str) -> DataFrame:
        if view.startswith("_") or view not in derived.VIEWS and view not in GRAPH and view not in SEEN:
            raise AttributeError(view)
        return self.table(view)
