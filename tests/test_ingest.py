import random
import subprocess

import pytest

from graphwright.model import CALLS, INHERITS
from graphwright.operators import activity, build, rules
from graphwright.plans.containment import contained
from graphwright.sinks import tables
from graphwright.sources import gitlog, repository, symbols

PYTHON = '''import os
from typing import List
from abc import ABC


class Store(ABC):
    def __init__(self, name: str):
        self.name = name

    def put(self, item):
        print(len(item))

    @property
    def size(self):
        return helper(self)


class DiskStore(Store):
    def flush(self):
        os.sync()


def main(path, *, deep=False):
    return DiskStore(path)


if __name__ == "__main__":
    main(".")
'''
TYPESCRIPT = """import fs, { join as j, resolve } from 'path';
import * as React from "react";
import './style.css';
// function hidden(a) {}
export class View extends Base implements Shown, Closed {
  private title: string;
  public open(target: string, deep?: boolean): void {
    this.render(target);
    if (deep) { load(target); }
  }
}
export const area = (w: number, h: number): number => multiply(w, h);
export default async function start(port) {
  area(1, 2); area(2, 3); new View();
}
interface Shown {}
"""
JAVA = """package a.b;
import java.util.List;
import static org.junit.Assert.assertTrue;
public class Bank extends Base implements Closeable, Runnable {
    public Bank(int size) { super(size); }
    public List<String> names(List<String> in, int n) throws Exception {
        return filter(in);
    }
    private static int count() { return Helper.total(1); }
}
enum Kind { A, B }
"""


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in {"app/store.py": PYTHON, "web/view.ts": TYPESCRIPT, "src/Bank.java": JAVA, "node_modules/x.js": "function no() {}", ".hidden/y.py": "def no(): pass", "web/lib.min.js": "f()", "app/other.py": "def helper(x):\n    return x\n\n\nclass Store:\n    pass\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "app/bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (root / "app/broken.py").write_text("def broken(:\n")
    return root


@pytest.fixture(scope="module")
def files(spark, repo):
    return repository.with_text(repository.read_files(spark, str(repo))).cache()


@pytest.fixture(scope="module")
def found(files):
    return symbols.extract(files).cache()


def names(found, kind, file):
    return {r["name"] if kind != "import" else r["module"] for r in found.filter(f"kind = '{kind}' and rel_path = '{file}'").collect()}


def test_walk_skips_folders_and_names(files):
    assert {r["rel_path"] for r in files.collect()} == {"app/store.py", "web/view.ts", "src/Bank.java", "app/other.py", "app/bad.py", "app/broken.py"}
    one = repository.metadata(files.filter("text is not null")).head()
    assert one["file_count"] == 5 and one["primary_extension"] == "py"


def test_python(found):
    assert names(found, "function", "app/store.py") == {"__init__", "put", "size", "flush", "main"}
    assert names(found, "import", "app/store.py") == {"os", "typing", "abc"}
    assert names(found, "call", "app/store.py") == {"print", "len", "helper", "main"}
    classes = {r["name"]: r for r in found.filter("kind = 'class' and rel_path = 'app/store.py'").collect()}
    assert classes["Store"]["methods"] == ["__init__", "put", "size"] and classes["DiskStore"]["bases"] == ["Store"]
    size = found.filter("name = 'size'").head()
    assert size["decorators"] == ["property"] and size["params"] == ["self"]
    assert found.filter("kind = 'error'").count() == 2


def test_typescript(found):
    f = "web/view.ts"
    assert names(found, "function", f) == {"open", "area", "start"}
    assert names(found, "class", f) == {"View", "Shown"}
    assert names(found, "import", f) == {"path", "react", "./style.css"}
    assert names(found, "call", f) == {"render", "load", "multiply", "area"}
    row = found.filter(f"kind = 'inheritance' and rel_path = '{f}'").head()
    assert row["bases"] == ["Base", "Shown", "Closed"]
    assert found.filter("name = 'open' and kind = 'function'").head()["params"] == ["target", "deep"]
    assert found.filter("module = 'path'").head()["names"] == ["fs", "join", "resolve"]
    assert found.filter("name = 'View' and kind = 'class'").head()["methods"] == ["open"]


def test_java(found):
    f = "src/Bank.java"
    assert names(found, "function", f) == {"Bank", "names", "count"}
    assert names(found, "class", f) == {"Bank", "Kind"}
    assert names(found, "import", f) == {"java.util", "org.junit.Assert"}
    assert names(found, "call", f) == {"filter", "total"}
    assert found.filter(f"kind = 'inheritance' and rel_path = '{f}'").head()["bases"] == ["Base", "Closeable", "Runnable"]
    assert found.filter("name = 'names' and kind = 'function'").head()["params"] == ["in", "n"]


def test_build_and_resolve(spark, files, found, tmp_path):
    g = build.build(files, found, "a1", "sample")
    inherits = {(r["src"], r["dst"]) for r in g.edges(INHERITS).collect()}
    assert inherits == {("class:a1:app/store.py:DiskStore", "class:a1:app/other.py:Store"), ("class:a1:web/view.ts:View", "class:a1:web/view.ts:Shown")}
    calls = {(r["src"].split(":")[-1], r["dst"].split(":")[-1]) for r in g.edges(CALLS).collect() if "store.py" in r["src"]}
    assert ("size", "helper") in calls and ("put", "main") in calls and ("main", "main") not in calls
    path = str(tmp_path / "graph")
    tables.write_graph(g, path, "a1")
    tables.write_graph(g, path, "a2")
    tables.write_graph(g, path, "a1")
    again = tables.read_graph(spark, path, "a1")
    assert again.nodes().count() == g.nodes().count() and tables.duplicate_ids(again.nodes()).count() == 0
    assert {tuple(r) for r in again.edges().collect()} == {tuple(r) for r in g.edges().collect()}
    tables.delete_analysis(spark, path, "a1")
    assert tables.read_graph(spark, path, "a1").nodes().count() == 0 and tables.read_graph(spark, path, "a2").nodes().count() > 0
    raw = spark.createDataFrame([("a", "b", "t"), ("a", "b", "t"), ("b", "a", "t")], "src string, dst string, rel_type string")
    assert tuple(build.edge_diagnostics(raw).head()) == (3, 2, 1)


def test_registry_and_upsert(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"x-1": {"owner": "x", "name": "one", "file_count": 3}, "y-2": {"owner": "y"}}')
    (tmp_path / "bad.json").write_text("{not json")
    found = tables.read_registry(spark, str(tmp_path / "r.json"))
    assert {(r["repo_id"], r["owner"], r["file_count"]) for r in found.collect()} == {("x-1", "x", 3), ("y-2", "y", None)}
    assert tables.read_registry(spark, str(tmp_path / "bad.json")).count() == 0
    changed = found.filter("repo_id = 'x-1'").replace("one", "uno")
    assert {r["name"] for r in tables.upsert(found, changed, "repo_id").collect()} == {"uno", None}


def test_gitlog(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=Ann@x.org", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, name in enumerate(["a.py", "b/c.py", "a.py"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(str(i))
        run("add", ".")
        run("commit", "-qm", f"change | number {i}")
    spark.dataSource.register(gitlog.GitLogSource)
    log = spark.read.format("gitlog").load(str(tmp_path))
    assert gitlog.commits(log).count() == 3
    assert {r["path"] for r in gitlog.commit_files(log).collect()} == {"a.py", "b/c.py"}
    from graphwright.model import Graph

    g = Graph({}, {}, lambda: gitlog.commits(log), lambda: gitlog.commit_files(log))
    assert {(r["email"], r["path"], r["share"]) for r in activity.ownership(g).collect()} == {("ann@x.org", "a.py", 1.0), ("ann@x.org", "b/c.py", 1.0)}


def test_entry_points_and_paths(spark):
    files = spark.createDataFrame([("app/main.py",), ("web/index.ts",), ("x/other.py",)], "rel_path string")
    functions = spark.createDataFrame([("list_all", "app/routes.py", ["Router.GET"]), ("plain", "app/routes.py", [])], "name string, file_path string, decorators array<string>")
    assert [(r["type"], r["path"]) for r in rules.entry_points(files, functions).collect()] == [("main", "app/main.py"), ("main", "web/index.ts"), ("route", "routes.py")]
    paths = spark.createDataFrame([("/home/r/a.py",), ("/var/folders/q/T/clone/b.py",), ("/tmp/z/c.py",), ("d\\e.py",)], "path string")
    known = spark.createDataFrame([("/home/r/a.py", "a.py")], "path string, rel_path string")
    assert {r["path"]: r["relative"] for r in rules.relative_paths(paths, known).collect()} == {"/home/r/a.py": "a.py", "/var/folders/q/T/clone/b.py": "b.py", "/tmp/z/c.py": "c.py", "d\\e.py": "d/e.py"}


def test_libraries_take_the_longest_key(spark):
    imports = spark.createDataFrame([("torch.nn",), ("torchvision",), ("PIL.Image",), ("cv2",)], "module string")
    known = rules.libraries(spark).unionByName(spark.createDataFrame([("torch.nn", "x")], "key string, category string"))
    assert {tuple(r) for r in rules.detect_libraries(imports, known).collect()} == {("torch.nn", "torch.nn"), ("pil.image", "pil"), ("cv2", "cv2")}


def test_gitlog_reads_merged_branches(spark, tmp_path):
    def run(who, *a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", f"user.name={who}", "-c", f"user.email={who}@x.org", *a], check=True, capture_output=True)

    def commit(who, name):
        (tmp_path / name).write_text(who)
        run(who, "add", ".")
        run(who, "commit", "-qm", name)

    run("ann", "init", "-q", "-b", "main")
    commit("ann", "a.py")
    run("ann", "checkout", "-qb", "side")
    commit("bob", "b.py")
    commit("bob", "c.py")
    run("ann", "checkout", "-q", "main")
    commit("ann", "d.py")
    run("cy", "merge", "-q", "--no-ff", "-m", "merge", "side")
    spark.dataSource.register(gitlog.GitLogSource)
    log = spark.read.format("gitlog").option("commits", 2).load(str(tmp_path))
    assert log.rdd.getNumPartitions() == 3
    assert sorted((r["author_name"], r["is_merge"]) for r in gitlog.commits(log).collect()) == [("ann", False), ("ann", False), ("bob", False), ("bob", False), ("cy", True)]
    from graphwright.api import Engine

    found = Engine(spark, str(tmp_path / "tables")).activity(str(tmp_path))
    assert found["overview"].head()["total_commits"] == 5
    assert {(r["email"], r["commit_count"]) for r in found["contributors"].collect()} == {("ann@x.org", 2), ("bob@x.org", 2)}
    assert {(r["email"], r["path"]) for r in found["ownership"].collect()} == {("ann@x.org", "a.py"), ("bob@x.org", "b.py"), ("bob@x.org", "c.py"), ("ann@x.org", "d.py")}


def test_clones_are_updated_and_paths_are_plain(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "clones" / "one"
    run = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", *a], check=True, capture_output=True)
    source.mkdir()
    run("init", "-q", "-b", "main")
    spark.dataSource.register(gitlog.GitLogSource)
    assert spark.read.format("gitlog").load(str(source)).count() == 0  # no commit yet
    for name in ("é.py", "b c.py"):
        (source / name).write_text("x = 1")
        run("add", ".")
        run("commit", "-qm", "m" * 300)
        assert gitlog.clone(str(source), str(target)) == str(target)
    log = spark.read.format("gitlog").load(str(target))
    assert {r["path"] for r in gitlog.commit_files(log).collect()} == {"é.py", "b c.py"}
    assert {len(r["message"]) for r in gitlog.commits(log).collect()} == {120}
    with pytest.raises(subprocess.CalledProcessError):
        gitlog.clone(str(tmp_path / "nowhere"), str(tmp_path / "clones" / "two"))
    assert sorted(p.name for p in (tmp_path / "clones").iterdir()) == ["one"]
    from graphwright.api import Engine

    engine = Engine(spark, str(tmp_path / "tables"))
    assert engine.stored_activity("one")["status"].head()["status"] == "unavailable" and engine.stored_activity("one")["contributors"].count() == 0
    engine.store_activity(str(target), "one")
    assert engine.stored_activity("one")["status"].head()["status"] == "available" and engine.stored_activity("two")["status"].head()["status"] == "unavailable"
    assert engine.stored_activity("one")["overview"].head()["total_commits"] == 2


def test_paths_that_hold_a_known_path(spark):
    """Anywhere, also within a name; the longest known path counts; null and empty paths; no comparison of all pairs."""
    texts = ["/srv/repo/src/a.ts", "/srv/repo/src/a.tsx", "x\\srv\\repo\\b", "/tmp/T/b.py", "/tmp/q/T/c/d\ne/b.py", "plain.py", "", None, "/srv/repo/src/a.ts", "/tmp/" + "d/" * 3000 + "srv/repo/end.py"]
    known = spark.createDataFrame([("/srv/repo", "r"), ("/srv/repo/src/a.ts", "lib/a.ts"), ("srv/repo/", ""), ("", "nothing"), (None, "none"), ("/srv/repo", "s")], "path string, rel_path string")
    paths = spark.createDataFrame([(x, 1) for x in texts], "path string, rel_path int")
    out = rules.relative_paths(paths, known)
    got = [(x["path"], x["relative"]) for x in out.collect()]
    assert sorted(got, key=str) == sorted([
        ("/srv/repo/src/a.ts", "lib/a.ts"), ("/srv/repo/src/a.ts", "lib/a.ts"), ("/srv/repo/src/a.tsx", "lib/a.tsx"), ("x\\srv\\repo\\b", "x/b"), ("/tmp/T/b.py", "b.py"), ("/tmp/q/T/c/d\ne/b.py", "d\ne/b.py"),
        ("plain.py", "plain.py"), ("", ""), (None, ""), (texts[-1], "tmp/" + "d/" * 3000 + "end.py")], key=str)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert rules.relative_paths(paths.limit(0), known).count() == 0 and rules.relative_paths(paths, known.limit(0)).count() == len(texts)


@pytest.mark.parametrize("seed", range(3))
def test_contained_is_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab/") for _ in range(n))
    texts = [word(r.choice((0, 3, 20, 150))) for _ in range(30)]
    parts = [word(r.choice((1, 2, 3, 5))) for _ in range(8)] + [t[i : i + 70] for t in texts[:9] for i in (0, 40)] + ["", None]
    got = contained(spark.createDataFrame([(x,) for x in [*texts, None]], "text string"), spark.createDataFrame([(x,) for x in parts], "part string")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} == {(t, p) for t in texts for p in parts if p and p in t}


def test_compatible_calls_hold_the_file_path(spark):
    files = spark.createDataFrame([("x.ts",), ("x.tsx",), ("y.ts",)], "rel_path string")
    columns = "kind string, rel_path string, name string, line int, params array<string>, decorators array<string>, bases array<string>, methods array<string>, module string, names array<string>, import_type string"
    rows = [("function", "x.ts", "f", 1), ("function", "x.tsx", "g", 1), ("function", "y.ts", "h", 1), ("call", "x.ts", "h", 2)]
    symbols = spark.createDataFrame([(*x, [], [], [], [], None, [], None) for x in rows], columns)
    calls = lambda **how: {tuple(x) for x in build.build(files, symbols, "an", "repo", **how).edges("FUNCTION_CALLS_FUNCTION").select("src", "dst").collect()}
    assert calls() == {("func:an:x.ts:f", "func:an:y.ts:h")}
    assert calls(compat=True) == calls() | {("func:an:x.tsx:g", "func:an:y.ts:h")}


def test_reading_guide_names_each_file_once(spark):
    from graphwright.model import CALLS, Graph, as_nodes

    paths = ["main.py", "a/cli.py", "b/worker.py", "c/core.py", "d/core.py", "models.py", "z/schema.py"]
    files = spark.createDataFrame([(f"file:{p}", p.split("/")[-1], p) for p in paths], "id string, name string, rel_path string")
    routes = spark.createDataFrame([("func:r", "r", "file:d/core.py", ["@app.get('/')"]), ("func:s", "s", "file:d/core.py", None)], "id string, name string, file_id string, decorators array<string>")
    edges = [(f"n{i}", f"file:{p}", CALLS) for p, n in (("c/core.py", 5), ("d/core.py", 4), ("models.py", 3)) for i in range(n)]
    g = Graph.of(as_nodes(files, "File").unionByName(as_nodes(routes, "Function")), spark.createDataFrame(edges, "src string, dst string, rel_type string"))
    assert [tuple(x) for x in rules.graph_entry_points(g).collect()] == [("cli", "cli.py", "a/cli.py"), ("worker", "worker.py", "b/worker.py"), ("main", "main.py", "main.py"), ("route", "r", "core.py")]
    assert [tuple(x) for x in rules.reading_guide(g).orderBy("step").collect()] == [(1, "entry", "a/cli.py"), (2, "entry", "b/worker.py"), (3, "central", "c/core.py"), (4, "central", "models.py"), (5, "model", "z/schema.py")]
    assert rules.domain_scores(rules.graph_features(g)).filter("domain = 'backend_api'").head()["score"] == 25
    none = Graph.of(as_nodes(files.limit(0), "File"), g.edges().limit(0))
    assert rules.reading_guide(none).count() == 0


def test_observations_need_all_wanted_and_no_other(spark):
    rows = [("library", "graph_db", f"s{i}.py", 1) for i in range(5)] + [("library", "graph_db", "s0.py", 1), ("entry", "route", "s1.py", 1), ("count", "functions", None, 16), ("count", "classes", None, 0), ("dependents", "x", "x", 5)]
    found = spark.createDataFrame(rows, "kind string, text string, path string, n long")
    got = {tuple(x) for x in rules.observations(found).collect()}
    assert got == {("decision", "stored as a graph, in no relational database", 5, "s0.py,s1.py,s2.py"), ("observation", "functions without classes", 0, ""), ("observation", "no file says what it is about", 0, "")}
    more = spark.createDataFrame([("library", "database", "d.py", 1), ("entry", "cli", "c.py", 1), ("path", "README.md", "README.md", 1)], "kind string, text string, path string, n long")
    assert {tuple(x) for x in rules.observations(found.unionByName(more)).collect()} == {("observation", "functions without classes", 0, ""), ("observation", "offered over HTTP and on the command line", 2, "c.py,s1.py")}
    assert [tuple(x) for x in rules.observations(found.limit(0)).collect()] == [("observation", "no file says what it is about", 0, "")]
