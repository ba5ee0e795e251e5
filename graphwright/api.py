"""What a user calls: analyse a folder, list analyses, and ask for graph, impact, search, simulation, architecture and activity.

Every answer is a DataFrame (or a dict of them). Analyses are partitions of tables under one folder, so many of them share it.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .operators import activity, build, impact, rules, search, structure
from .sinks import tables
from .sources import gitlog, repository, symbols

URL = re.compile(r"^https?://[\w.-]+/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$")
MOST_FILES = 40_000
REGISTRY = "file_count long, total_lines long, primary_extension string, name string, path string, repo_id string"
COMMITS = "sha string, author_name string, author_email string, committed_at timestamp, is_merge boolean, message string, analysis_id string"
COMMIT_FILES = "sha string, path string, analysis_id string"


def repository_id(url: str) -> tuple[str, str, str]:
    """id, owner and name of a repository's address; ValueError for anything else."""
    if not (found := URL.match(url.strip())):
        raise ValueError(f"not a repository address: {url}")
    owner, name = found.groups()
    return re.sub(r"[^A-Za-z0-9_-]", "-", f"{owner}-{name}").lower(), owner, name


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _graph(self, analysis: str) -> Graph:
        return tables.read_graph(self.spark, f"{self.folder}/graph", analysis)

    def analyze_path(self, root: str, analysis: str, name: str, most_files: int = MOST_FILES) -> dict[str, int]:
        """Scan, parse, resolve and store a folder; returns the milliseconds of each stage. Running it again replaces the analysis."""
        took, began = {}, time.time()

        def lap(stage: str) -> None:
            nonlocal began
            took[stage], began = round(1000 * (time.time() - began)), time.time()

        files = repository.with_text(repository.read_files(self.spark, root)).persist()
        try:
            meta = repository.metadata(files.filter("text is not null")).withColumns({"repo_id": F.lit(analysis), "name": F.lit(name), "path": F.lit(root)})
            if (n := files.count()) > most_files:
                raise ValueError(f"{n} files, more than {most_files}")
            lap("scan")
            found = symbols.extract(files).persist()
            found.count()
            lap("parse")
            tables.write_graph(build.build(files, found, analysis, name), f"{self.folder}/graph", analysis)
            meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{self.folder}/registry")
            found.unpersist()
            lap("store")
        finally:
            files.unpersist()
        return took

    def import_repository(self, url: str, clones: str) -> str:
        """Clone an address below the folder clones (on the driver) and return its id."""
        analysis, _, _ = repository_id(url)
        gitlog.clone(url.strip(), f"{clones.rstrip('/')}/{analysis}")
        return analysis

    def analyze(self, url: str, clones: str, most_files: int = MOST_FILES) -> dict[str, int]:
        """Import, analyse and store a repository by its address, and its activity; the milliseconds of each stage."""
        began = time.time()
        analysis, _, name = repository_id(url)
        self.import_repository(url, clones)
        took = {"clone": round(1000 * (time.time() - began))}
        took |= self.analyze_path(f"{clones.rstrip('/')}/{analysis}", analysis, name, most_files)
        began = time.time()
        self.store_activity(f"{clones.rstrip('/')}/{analysis}", analysis)
        return took | {"git": round(1000 * (time.time() - began))}

    def list_repositories(self) -> DataFrame:
        """The registry; empty before the first analysis."""
        if not tables.exists(self.spark, f"{self.folder}/registry"):
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.folder}/registry")

    def get_repository(self, analysis: str) -> DataFrame:
        return self.list_repositories().filter(F.col("repo_id") == analysis)

    def status(self, analysis: str) -> DataFrame:
        """One row: complete if the registry has the analysis, else unknown."""
        return self.get_repository(analysis).agg(F.when(F.count(F.lit(1)) > 0, "complete").otherwise("unknown").alias("status"))

    def delete(self, analysis: str) -> None:
        """Remove an analysis: its graph, its stored activity and its row of the registry."""
        tables.delete_analysis(self.spark, f"{self.folder}/graph", analysis)
        for part in (f"registry/repo_id={analysis}", f"commits/analysis_id={analysis}", f"commit_files/analysis_id={analysis}"):
            tables.delete_partition(self.spark, f"{self.folder}/{part}")

    def graph(self, analysis: str) -> dict[str, DataFrame]:
        g = self._graph(analysis)
        return {"nodes": structure.nodes_scan(g), "edges": structure.edges_scan(g), "overview": structure.overview(g)}

    def _target(self, g: Graph, text: str) -> tuple[str, str] | None:
        row = structure.find_target(g, text).head()
        return row and (row["id"], row["type"].capitalize())

    def _seed(self, g: Graph, target: str) -> tuple[str, DataFrame]:
        """Label and id (a frame of one row, or none) of the first node whose name, path or module holds target."""
        found = self._target(g, target)
        return found[1] if found else "Function", self.spark.createDataFrame([(found[0],)] if found else [], "id string")

    def impact(self, analysis: str, target: str) -> DataFrame:
        """Risk of the first node whose name, path or module holds target; empty if there is none. Only its surroundings are read."""
        g = self._graph(analysis)
        label, seed = self._seed(g, target)
        return impact.impact_scores(g, label, seed)

    def impact_report(self, analysis: str, target: str) -> DataFrame:
        """What the target's change reaches: names and numbers by type, on both sides."""
        g = self._graph(analysis)
        return impact.impact_report(g, self._seed(g, target)[1])

    def simulate_change(self, analysis: str, target: str) -> DataFrame:
        g = self._graph(analysis)
        label, seed = self._seed(g, target)
        return impact.change_simulation(g, label, seed)

    def search(self, analysis: str, query: str, limit: int = 50) -> DataFrame:
        return search.search(self._graph(analysis), query, limit)

    def architecture(self, analysis: str) -> dict[str, DataFrame]:
        g = self._graph(analysis)
        scores = rules.domain_scores(rules.graph_features(g))
        known = rules.libraries(self.spark)
        return {
            "overview": structure.overview(g), "modules": rules.module_roles(g), "files": structure.file_hotspots(g), "functions": structure.function_hotspots(g),
            "classes": structure.class_hotspots(g), "chains": structure.inheritance_chains(g), "cycles": structure.closed_trails(g), "coupled": structure.coupled_files(g),
            "risk": structure.architecture_risk(g), "health": structure.health(g), "complexity": structure.complexity(g), "domain": rules.best_domain(scores),
            "libraries": rules.library_evidence(g, known), "layers": rules.layers(g), "onboarding": structure.onboarding(g), "minutes": rules.onboarding_minutes(g),
            "responsibilities": rules.responsibilities(g), "entry_points": rules.graph_entry_points(g), "pattern": rules.best_pattern(rules.architecture_pattern(rules.tokens(g))),
            "critical_files": impact.critical_files(g), "start_here": rules.reading_guide(g), "summary": structure.summary(g),
            "observations": rules.observations(rules.signals(g, known)),
        }

    def _log(self, clone: str) -> DataFrame:
        self.spark.dataSource.register(gitlog.GitLogSource)
        return self.spark.read.format("gitlog").load(clone)

    def store_activity(self, clone: str, analysis: str) -> None:
        """Write the commits of a local clone beside the graph, so that stored_activity() needs no clone."""
        log = self._log(clone).persist()
        try:
            for name, rows in (("commits", gitlog.commits(log)), ("commit_files", gitlog.commit_files(log))):
                tables.delete_partition(self.spark, f"{self.folder}/{name}/analysis_id={analysis}")
                tables._write(rows.withColumn("analysis_id", F.lit(analysis)), f"{self.folder}/{name}")
        finally:
            log.unpersist()

    def stored_activity(self, analysis: str) -> dict[str, DataFrame]:
        """From what store_activity() wrote; status says available, or unavailable where nothing was stored (the other frames are empty then)."""

        def own(name: str, schema: str) -> DataFrame:
            if not tables.exists(self.spark, f"{self.folder}/{name}/analysis_id={analysis}"):
                return self.spark.createDataFrame([], schema).drop("analysis_id")
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").filter(F.col("analysis_id") == analysis).drop("analysis_id")

        found = self._activity(Graph({}, {}, lambda: own("commits", COMMITS), lambda: own("commit_files", COMMIT_FILES)))
        status = own("commits", COMMITS).agg(F.when(F.count(F.lit(1)) > 0, "available").otherwise("unavailable").alias("status"))
        return found | {"status": status}

    def _activity(self, g: Graph) -> dict[str, DataFrame]:
        return {"overview": activity.overview(g), "commits": activity.recent(g), "recent": activity.recent_files(g), "contributors": activity.contributors(g), "ownership": activity.ownership(g), "areas": activity.primary_areas(g)}

    def activity(self, clone: str) -> dict[str, DataFrame]:
        """From a local clone's history. Merges count in the overview only."""
        log = self._log(clone).persist()
        found = self._activity(Graph({}, {}, lambda: gitlog.commits(log), lambda: gitlog.commit_files(log)))
        return found | {"overview": found["overview"].withColumn("branch", F.lit(gitlog.branch(clone)))}
