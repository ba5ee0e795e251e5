import pytest

from graphwright.api import Engine, repository_id

from .test_ingest import JAVA, PYTHON


def test_addresses():
    assert repository_id("https://host.org/Some.Owner/a_repo.git") == ("some-owner-a_repo", "Some.Owner", "a_repo")
    with pytest.raises(ValueError):
        repository_id("ftp://x/y")


def test_analysis_end_to_end(spark, tmp_path):
    root = tmp_path / "code"
    (root / "app").mkdir(parents=True)
    (root / "app/store.py").write_text(PYTHON)
    (root / "app/routes.py").write_text("from flask import Flask\nfrom app.store import main\n\n\ndef index():\n    return main('x')\n")
    (root / "Bank.java").write_text(JAVA)
    engine = Engine(spark, str(tmp_path / "tables"))
    took = engine.analyze_path(str(root), "one", "sample")
    assert set(took) == {"scan", "parse", "store"}
    assert engine.status("one").head()["status"] == "complete" and engine.status("two").head()["status"] == "unknown"
    assert engine.get_repository("one").head()["file_count"] == 3
    assert engine.graph("one")["overview"].head()["file_count"] == 3
    assert engine.impact("one", "helper").count() == 0
    hit = engine.impact("one", "index").head()
    assert hit["target"].endswith("routes.py:index") and hit["risk_score"] >= 20
    assert engine.simulate_change("one", "index").head()["direct"] >= 1
    assert engine.search("one", "STORE").head()["name"] == "Store"
    parts = engine.architecture("one")
    assert parts["libraries"].filter("key = 'flask'").count() == 1
    assert parts["risk"].head()["risk_score"] >= 30 and parts["domain"].head()["domain"] == "Unknown"
    assert engine.list_repositories().count() == 1
    with pytest.raises(ValueError):
        engine.analyze_path(str(root), "two", "sample", most_files=1)


def test_registry_before_and_after(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("from x import alpha, beta\n\n\n@route\ndef run(p):\n    pass\n")
    engine = Engine(spark, str(tmp_path / "tables"))
    assert engine.status("one").head()["status"] == "unknown" and engine.list_repositories().count() == 0
    engine.analyze_path(str(root), "one", "sample")
    assert engine.search("one", "beta").head()["name"] == "x"
    node = engine._graph("one").nodes("Function").head()
    assert node["params"] == ["p"] and node["decorators"] == ["route"] and node["line_number"] > 0
    engine.delete("one")
    assert engine.status("one").head()["status"] == "unknown" and engine._graph("one").nodes().count() == 0


def test_activity_is_stored(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=ann", "-c", "user.email=Ann@x.org", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "trunk")
    (tmp_path / "r/a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "first change")
    engine = Engine(spark, str(tmp_path / "tables"))
    engine.store_activity(str(tmp_path / "r"), "one")
    assert engine.stored_activity("one")["commits"].head()["message"] == "first change"
    assert engine.stored_activity("one")["contributors"].head()["email"] == "ann@x.org"
    assert engine.activity(str(tmp_path / "r"))["overview"].head()["branch"] == "trunk"
    engine.delete("one")
    assert engine.stored_activity("one")["commits"].count() == 0
