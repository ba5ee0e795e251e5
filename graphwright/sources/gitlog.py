"""A Spark data source over a local clone's history: spark.read.format("gitlog").load(folder).

One row for each commit and path (path is null for a commit without files, and for a merge); commits() and commit_files() project it.
All commits that HEAD reaches are read, in partitions of the option `commits` each.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sha string, author_name string, author_email string, committed_at string, is_merge boolean, subject string, path string"
MARK, CUT = "\x1e", "\x1f"


class Commits(InputPartition):
    def __init__(self, skip: int, count: int):
        self.skip, self.count = skip, count


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("commits", 5000))

    def partitions(self) -> list[Commits]:
        git = ["git", "-C", self.folder]
        if subprocess.run([*git, "rev-parse", "--git-dir"], capture_output=True, check=True) and subprocess.run([*git, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True).returncode:
            return [Commits(0, 0)]  # a repository without commits
        done = subprocess.run([*git, "rev-list", "--count", "HEAD"], capture_output=True, check=True)
        return [Commits(i, self.size) for i in range(0, int(done.stdout), self.size)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.count:
            return
        form = MARK + CUT.join(("%H", "%an", "%ae", "%cI", "%P", "%s"))
        command = ["git", "-c", "core.quotePath=off", "-C", self.folder, "log", "--name-only", f"--skip={partition.skip}", f"--max-count={partition.count}", f"--format={form}", "HEAD"]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as git:
            head, bare = None, False
            for raw in git.stdout:
                line = raw.decode("utf-8", "replace").rstrip("\n")
                if line.startswith(MARK):
                    if bare:
                        yield *head, None
                    sha, name, email, date, parents, subject = line[1:].split(CUT, 5)
                    head, bare = (sha, name, email, date, len(parents.split()) > 1, subject), True
                elif line:
                    bare = False
                    yield *head, line
            if bare:
                yield *head, None
        if git.returncode:
            raise RuntimeError(f"git log ended with {git.returncode}")


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


def branch(folder: str) -> str | None:
    """The branch that is checked out; none where HEAD is detached or there is no repository. Runs on the driver."""
    done = subprocess.run(["git", "-C", folder, "symbolic-ref", "--short", "-q", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None


def clone(url: str, folder: str, seconds: int = 600) -> str:
    """A clone of url in folder, on the driver; an existing one is brought to what its origin's branch has now. Returns the folder.

    The clone is made under another name and takes its own when it is whole, so one that was broken off is never taken for a clone.
    """
    run = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True, timeout=seconds)
    if os.path.isdir(os.path.join(folder, ".git")):
        run("-C", folder, "fetch", "--quiet", "origin")
        if subprocess.run(["git", "-C", folder, "rev-parse", "-q", "--verify", "@{upstream}"], capture_output=True).returncode == 0:
            run("-C", folder, "reset", "--quiet", "--hard", "@{upstream}")
        return folder
    os.makedirs(os.path.dirname(folder) or ".", exist_ok=True)
    beside = tempfile.mkdtemp(prefix=".clone-", dir=os.path.dirname(folder) or ".")
    try:
        run("clone", "--quiet", "--", url, f"{beside}/new")
        os.rename(f"{beside}/new", folder)
    finally:
        shutil.rmtree(beside, ignore_errors=True)
    return folder


def commits(log: DataFrame) -> DataFrame:
    """One row for each commit; times are instants, whatever offset they were written with."""
    return log.select("sha", "author_name", "author_email", F.to_timestamp("committed_at").alias("committed_at"), "is_merge", F.substring("subject", 1, 120).alias("message")).distinct()


def commit_files(log: DataFrame) -> DataFrame:
    return log.filter("path is not null").select("sha", "path").distinct()
