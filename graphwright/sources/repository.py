"""Source files of a repository as a DataFrame, and figures about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions with their language, names that are skipped.
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx"}
SKIPPED_DIRS = ["node_modules", "venv", "env", "__pycache__", "dist", "build", "target", "coverage", "site-packages", "vendor"]
SKIPPED_ENDS = [".min.js", ".min.ts", ".d.ts"]


def _relative(root: str) -> Column:
    """The path below root; Spark's paths carry a scheme."""
    folder = root.rstrip("/") + "/"
    return F.substring(F.col("path"), F.locate(folder, F.col("path")) + len(folder), F.length("path"))


def read_files(spark: SparkSession, root: str, languages: dict[str, str] = LANGUAGES, limit: int | None = None) -> DataFrame:
    """path, rel_path, language and content of the source files below root; limit keeps the first by path.

    Folders that start with a dot, are in SKIPPED_DIRS or end in egg-info are left out, and names that end in SKIPPED_ENDS.
    """
    parts = F.split("rel_path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.exists(folders, lambda d: d.startswith(".") | d.isin(SKIPPED_DIRS) | d.endswith("egg-info"))
    names = F.create_map(*(F.lit(x) for pair in languages.items() for x in pair))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("rel_path", _relative(root))
    for end in SKIPPED_ENDS:
        files = files.filter(~F.col("rel_path").endswith(end))
    files = files.filter(~skipped).withColumn("language", F.try_element_at(names, F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))).filter("language is not null")
    files = files.select("path", "rel_path", "language", "content")
    return files if limit is None else files.orderBy("rel_path").limit(limit)


def with_text(files: DataFrame) -> DataFrame:
    """text of each file, and error where a Python file is not UTF-8; other languages get replacement characters."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    wrong = ~valid & (F.col("language") == "python")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumns({"error": F.when(wrong, F.lit("not valid UTF-8")), "text": F.when(~wrong, text)}).drop("content")


def lines(files: DataFrame) -> DataFrame:
    """path, rel_path, language, line (from 1) and code."""
    return files.filter("text is not null").select("path", "rel_path", "language", F.posexplode(F.split("text", "\n")).alias("at", "code")).withColumn("line", F.col("at") + 1).drop("at")


def metadata(files: DataFrame) -> DataFrame:
    """One row: files, lines (a newline at the end adds none) and the most frequent extension, the first of equal ones by name."""
    counted = files.select(F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).alias("ext"),
                           F.when(F.length("text") == 0, 0).otherwise(F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))).alias("n"))
    by_ext = counted.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))
    return by_ext.agg(F.sum("files").alias("file_count"), F.sum("lines").alias("total_lines"), F.max_by("ext", F.struct("files", F.negative(F.ascii("ext")))).alias("primary_extension"))


def languages_found(symbols: DataFrame) -> DataFrame:
    return symbols.select("path", "language").distinct().groupBy("language").agg(F.count(F.lit(1)).alias("files"))
