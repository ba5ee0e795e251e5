"""What nodes reach in one or two steps, as bitmaps of dense node numbers where that is less than listing pairs.

Each node has a number; numbers of a label begin at a multiple of a bitmap's 32,768 bits, so a bucket of numbers holds nodes of one label. The
neighbours of an intermediate node that lie in one bucket are listed if they are few and become a bitmap of 4 KB from DENSE on, about where
joining bitmaps takes less time than sorting pairs: in x out pairs of a hub become out bitmaps for each bucket of its neighbours, that are joined by OR as they are aggregated. Only
targets that get a bitmap are kept as bitmaps; for the others pairs of numbers are made distinct. A sparse graph thus is listed, a dense one is not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

BITS = 32_768
DENSE = 32
PARTS = 1_024


def numbered(ids: DataFrame) -> DataFrame:
    """(id, label, n) of distinct ids: numbers from 0 without gaps within a label. ids: id and label (null: a label of its own).

    Ids are ranked within PARTS parts by their hash, and the parts' sizes, a small table, give the offsets: no sort of all ids.
    """
    # A label that is not null stands for an id that has both.
    rows = ids.groupBy("id").agg(F.max("label").alias("label")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("label", "part").orderBy("id")) - 1)
    sizes = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    labels = sizes.groupBy("label").agg((F.ceil(F.sum("size") / BITS) * BITS).alias("room"))
    labels = labels.withColumn("base", F.coalesce(F.sum("room").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each label
    sizes = sizes.alias("s").join(F.broadcast(labels.alias("l")), F.col("s.label").eqNullSafe(F.col("l.label"))).select("s.label", "s.part", (F.col("within") + F.col("base")).alias("offset"))
    joined = rows.alias("r").join(F.broadcast(sizes.alias("s")), F.col("r.label").eqNullSafe(F.col("s.label")) & (F.col("r.part") == F.col("s.part")))  # at most PARTS rows for each label
    return joined.select("r.id", "r.label", (F.col("offset") + F.col("place")).cast("long").alias("n"))


def bucket(n: Column) -> Column:
    return F.floor(n / BITS).cast("long")


@dataclass
class Steps:
    """How nodes with a number reach targets in one or two directed steps: what() gives the parts, which say the same about some pairs several times."""

    known: DataFrame  # a, b, n, bucket: an arc from a (number n) to b
    last: DataFrame  # via, target: the second steps
    dense: DataFrame  # via, bucket, members: what stands before an intermediate node, where it is many
    targets: DataFrame  # id

    def held(self) -> DataFrame:
        """target of those that get a bitmap."""
        return self.last.join(self.dense.select("via").distinct(), "via", "left_semi").select("target").distinct()

    def listed(self) -> DataFrame:
        """(target, bucket, n)"""
        direct = self.known.join(self.targets.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("b").alias("target"), "bucket", "n")
        sparse = self.known.filter("a <> b").select(F.col("b").alias("via"), "bucket", "n").join(self.dense.select("via", "bucket"), ["via", "bucket"], "left_anti")
        return direct.unionByName(self.last.join(sparse, "via").select("target", "bucket", "n"))

    def mapped(self) -> DataFrame:
        """(target, bucket, members). The partitions' number is given: by its small inputs Spark would put the join, whose rows hold a bitmap each, into one task."""
        parts = int(self.last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.last.repartition(parts, "via").join(self.dense.repartition(parts, "via"), "via").select("target", "bucket", "members")


def steps(pairs: DataFrame, targets: DataFrame, numbers: DataFrame) -> Steps:
    """pairs: distinct a, b. targets: id. As in traverse.walk2 loops lead nowhere else, so the second step needs no edge identities.

    pairs and numbers should be settled: they are read several times.
    """
    targets = targets.select("id").distinct()
    known = settled(pairs.join(numbers.select(F.col("id").alias("a"), "n"), "a").select("a", "b", "n", bucket(F.col("n")).alias("bucket")))
    last = pairs.filter("a <> b").join(targets.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("via"), F.col("b").alias("target"))
    before = known.filter("a <> b").groupBy(F.col("b").alias("via"), "bucket")
    many = before.agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= DENSE).select("via", "bucket")
    dense = known.filter("a <> b").select(F.col("b").alias("via"), "bucket", "n").join(many, ["via", "bucket"], "left_semi").groupBy("via", "bucket").agg(F.bitmap_construct_agg(F.col("n") % BITS).alias("members"))
    return Steps(known, last, settled(dense), targets)


def sparse(pairs: DataFrame, targets: DataFrame) -> bool:
    """Whether no intermediate node of the targets has DENSE nodes before it, so that listing pairs is all there is to do. One small job; pairs should be settled."""
    vias = pairs.filter("a <> b").join(targets.select(F.col("id").alias("b")), "b", "left_semi").select("a")
    return pairs.join(vias.select(F.col("a").alias("b")), "b", "left_semi").groupBy("b").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= DENSE).isEmpty()


def merged(**sides: Steps) -> tuple[DataFrame, DataFrame]:
    """(side, target, bucket, n) without repetition for targets without bitmaps, and (target, bucket, a bitmap for each side, whole) for the others."""
    each = lambda f: reduce(DataFrame.unionByName, (f(x).withColumn("side", F.lit(name)) for name, x in sides.items()))
    held, listed = each(Steps.held).select("target").distinct(), each(Steps.listed)
    few = listed.join(held, "target", "left_anti").distinct()
    own = listed.join(held, "target", "left_semi").distinct().groupBy("side", "target", "bucket").agg(F.bitmap_construct_agg(F.col("n") % BITS).alias("members"))
    maps = each(Steps.mapped).unionByName(own, allowMissingColumns=False)
    ors = [F.bitmap_or_agg(F.when(F.col("side") == s, F.col("members"))).alias(s) for s in sides]
    return few, maps.groupBy("target", "bucket").agg(*ors, F.bitmap_or_agg("members").alias("whole"))


def numbers_of(members: Column, at: Column) -> Column:
    """Array of the numbers in a bitmap of a bucket: words of four bytes, then their bits. The first bit of a byte is its lowest."""
    words = F.transform(F.sequence(F.lit(0), F.lit(BITS // 32 - 1)), lambda k: F.struct(k.alias("k"), F.conv(F.hex(F.substring(members, 4 * k + 1, F.lit(4))), 16, 10).cast("long").alias("v")))
    set_ = F.filter(words, lambda w: w["v"] != 0)

    def bits(w: Column) -> Column:
        on = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda j: F.floor(w["v"] / F.pow(F.lit(2.0), 8 * (3 - F.floor(j / 8)) + j % 8)).cast("long") % 2 == 1)
        return F.transform(on, lambda j: at * BITS + w["k"] * 32 + j)

    return F.flatten(F.transform(set_, bits))


def pairs_of(found: Steps, numbers: DataFrame) -> DataFrame:
    """Distinct (target, id)."""
    few, whole = merged(one=found)
    out = whole.select("target", F.explode(numbers_of(F.col("whole"), F.col("bucket"))).alias("n")).unionByName(few.select("target", "n"))
    return out.join(numbers.select("n", "id"), "n").select("target", "id")


def kind_counts(numbers: DataFrame, kinds: list[str], **sides: Steps) -> DataFrame:
    """(target, a count for each side, total: in any side, and a count for each label over all sides together). A bucket holds one label, so bitmaps are counted, not opened."""
    few, whole = merged(**sides)
    labels = numbers.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.min("label").alias("label"))
    of = lambda c: [F.sum(F.when(F.col("label") == k, c).otherwise(0)).alias(k) for k in kinds]
    listed = few.join(labels, "bucket").groupBy("target").agg(*(F.count_if(F.col("side") == s).alias(s) for s in sides), F.count_distinct("n").alias("total"), *of(F.lit(1)))
    sized = whole.join(labels, "bucket").select("target", "label", *(F.bitmap_count(s).alias(s) for s in sides), F.bitmap_count("whole").alias("total"))
    mapped = sized.groupBy("target").agg(*(F.sum(s).alias(s) for s in [*sides, "total"]), *of(sum(F.col(s) for s in sides)))
    return listed.unionByName(mapped)


def counts_of(found: Steps) -> DataFrame:
    """(target, n): how many different nodes reach each target; none is no row."""
    few, whole = merged(one=found)
    size = whole.select("target", F.bitmap_count("whole").alias("n")).unionByName(few.groupBy("target").agg(F.count(F.lit(1)).alias("n")))
    return size.groupBy("target").agg(F.sum("n").alias("n"))
