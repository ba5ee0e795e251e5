"""Activity: commits, contributors and ownership. Every order ends in a key, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph


def overview(g: Graph) -> DataFrame:
    """Commits with merges, last date, and authors by e-mail as written."""
    return g.commits().agg(F.count(F.lit(1)).alias("total_commits"), F.max("committed_at").alias("last_commit"), F.count_distinct("author_email").alias("contributors"))


def recent(g: Graph, keep: int = 50) -> DataFrame:
    """The newest commits without merges; with their messages where the log has them."""
    top = g.commits().filter("not is_merge").orderBy(F.desc("committed_at"), "sha").limit(keep)
    more = ["message"] if "message" in top.columns else []
    return top.select(F.substring("sha", 1, 12).alias("sha"), F.col("author_name").alias("author"), "committed_at", *more)


def recent_files(g: Graph, keep: int = 50) -> DataFrame:
    """Recent commits with their files, sorted and comma-joined; commits without files stay."""
    top = g.commits().filter("not is_merge").orderBy(F.desc("committed_at"), "sha").limit(keep).select("sha", "committed_at")
    return top.join(g.commit_files(), "sha", "left").groupBy("sha", "committed_at").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))


def _by_email(g: Graph, merges: bool = False) -> DataFrame:
    """Commits with the lower-cased e-mail; contributors and owners are counted without merges."""
    commits = g.commits() if merges else g.commits().filter("not is_merge")
    return commits.withColumn("email", F.lower("author_email"))


def contributors(g: Graph) -> DataFrame:
    """Commits, last date and the name last used for every lower-cased e-mail."""
    return _by_email(g).groupBy("email").agg(F.count(F.lit(1)).alias("commit_count"), F.max("committed_at").alias("last_commit"), F.max_by("author_name", F.struct("committed_at", "sha")).alias("name"))


def contributor_files(g: Graph) -> DataFrame:
    """Commits and last touch of every contributor and file."""
    return _by_email(g).join(g.commit_files(), "sha").groupBy("email", "path").agg(F.count(F.lit(1)).alias("n"), F.max("committed_at").alias("last_touch"))


def ownership(g: Graph) -> DataFrame:
    """Share of a file's commits that each contributor has. Totals come from a join, not from a window over a hot file."""
    own = contributor_files(g)
    total = g.commits().filter("not is_merge").select("sha").join(g.commit_files(), "sha").groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    return own.join(total, "path").select("email", "path", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))


def file_totals(g: Graph) -> DataFrame:
    return g.commits().filter("not is_merge").select("sha").join(g.commit_files(), "sha").groupBy("path").agg(F.count(F.lit(1)).alias("total"))


def top_files(g: Graph, keep: int = 20) -> DataFrame:
    rank = Window.partitionBy("email").orderBy(F.desc("n"), "path")
    return contributor_files(g).withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= keep).select("email", "path", "n", "place")


def primary_areas(g: Graph, files: int = 20, keep: int = 5) -> DataFrame:
    """First path segments over a contributor's top files."""
    area = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("(root)")
    counted = top_files(g, files).groupBy("email", area.alias("area")).agg(F.count(F.lit(1)).alias("files"))
    rank = Window.partitionBy("email").orderBy(F.desc("files"), "area")
    return counted.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= keep).groupBy("email").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "area"))), lambda x: x["area"]), ",").alias("areas"))


def ranking(g: Graph, keep: int = 25) -> DataFrame:
    return contributors(g).orderBy(F.desc("commit_count"), "email").limit(keep)


def profile(g: Graph) -> DataFrame:
    """Every contributor with commits, number of files and areas; contributors without files stay."""
    files = contributor_files(g).groupBy("email").agg(F.count(F.lit(1)).alias("files"))
    return contributors(g).select("email", "commit_count").join(files, "email", "left").join(primary_areas(g), "email", "left").select("email", "commit_count", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("areas", F.lit("")).alias("areas"))


def panel(g: Graph, email: str, name: str) -> DataFrame:
    """Commits of a contributor by e-mail or name."""
    return _by_email(g, merges=True).filter((F.col("email") == email.lower()) | (F.col("author_name") == name)).select("sha", "committed_at")


def average_ownership(g: Graph) -> DataFrame:
    """Whole per cent, halves up. Shares have three places, so their sum is taken in thousandths, which no order of rows changes."""
    shares = ownership(g).groupBy("email").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    return shares.select("email", F.expr("(2 * s + 10 * n) div (20 * n)").alias("average_pct"))


def relative_time(then: Column, now: Column) -> Column:
    """Minutes, hours, days or months before now, rounded down."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 60, text(minutes, "m ago")).when(minutes < 1440, text(F.floor(minutes / 60), "h ago")).when(minutes < 43200, text(F.floor(minutes / 1440), "d ago")).otherwise(text(F.floor(minutes / 43200), "mo ago"))


def ages(g: Graph, now: str) -> DataFrame:
    """How long before now (a timestamp as text) each commit was."""
    return g.commits().select("sha", relative_time(F.col("committed_at").cast("timestamp"), F.lit(now).cast("timestamp")).alias("age"))


def telemetry(g: Graph) -> DataFrame:
    """Actions with their number, successes and mean duration. Not part of the reference, which only logs them."""
    return g.tables("events").groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("successes"), F.round(F.avg("value"), 3).alias("mean_ms"))
