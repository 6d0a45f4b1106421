"""Classes of rows from candidate buckets, without listing the pairs of a bucket.

Rows of one bucket may be alike. In a group of near copies nearly all share their buckets,
and comparing each with one centre already connects most of them; the only pairs left to
compare are those of a bucket that lie in different classes by then. So no link between
two classes is lost, and pairs within a class are never listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurekit.llm.tables import release, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id in links (a, b).

    Labels fall to the smallest of the neighbours', then to their label's label, until
    none changes; every step is a table in the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a != b").distinct())
    older = labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        seen = labels.select(F.col("id").alias("b"), "label")
        near = edges.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("id").alias("lower"), F.col("label").alias("jump"))
        found = lower.join(jump, "lower").select(
            "id", F.least("lower", "jump").alias("label"), (F.least("lower", "jump") < F.col("label")).alias("fell")
        )
        found = written(found)
        release(older)
        older, labels = found, found.select("id", "label")
        if not found.where("fell").take(1):
            release(edges)
            return labels.withColumnRenamed("label", "component")


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (key, id) of buckets with two ids at least, written."""
    of_key = Window.partitionBy("key")
    spread = buckets.select("key", "id", (F.min("id").over(of_key) < F.max("id").over(of_key)).alias("_shared"))
    return written(spread.where("_shared").select("key", "id"))


def pairs_between(rows: DataFrame, near: Column | None = None) -> DataFrame:
    """The distinct pairs (a, b), a < b, of ids that share a key and differ in ``class``.

    near: a condition on the rows' columns, prefixed a_ and b_, that all links meet; the join
    itself applies it.
    """
    left = rows.select("key", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != "key"])
    right = rows.select("key", *[F.col(c).alias(f"b_{c}") for c in rows.columns if c != "key"])
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_class") != F.col("b_class"))
    joined = left.join(right, "key").where(apart if near is None else apart & near)
    return joined.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def connect(
    buckets: DataFrame,
    alike: Callable[[DataFrame], DataFrame],
    between: Callable[[DataFrame], DataFrame] = pairs_between,
) -> DataFrame:
    """(id, component) for every id that is linked with another.

    buckets: (key, id), small enough to be written and read some times (as
    :func:`shared_buckets` gives it); alike: keeps the true links of distinct pairs (a, b),
    a < b; between: the pairs that may be links among rows (key, id, class), as
    :func:`pairs_between` finds them.
    """
    of_key = Window.partitionBy("key")
    members = written(buckets.distinct().withColumn("centre", F.min("id").over(of_key)))

    # Each id with the smallest centre it meets.
    first = members.where("id > centre").groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a"))
    links = written(alike(first.select("a", "b")).select("a", "b"))

    # Each id with the other centres it meets, where the classes still differ.
    found = components(links)

    def classes(rows: DataFrame, column: str) -> DataFrame:
        known = found.select(F.col("id").alias(column), F.col("component").alias(f"{column}_class"))
        return rows.join(known, column, "left").withColumn(f"{column}_class", F.coalesce(f"{column}_class", column))

    apart = members.where("id > centre").join(first.select(F.col("a").alias("centre"), F.col("b").alias("id")), ["centre", "id"], "left_anti")
    apart = classes(classes(apart.select("id", "centre").distinct(), "id"), "centre")
    more = apart.where("id_class != centre_class").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    more = written(alike(more).select("a", "b"))
    if more.take(1):
        older, links = links, written(links.union(more))
        release(older)
        found = components(links)
    release(more)

    # What is left: pairs of a bucket in different classes, neither of them its centre.
    known = classes(members, "id").where("id != centre")
    mixed = known.withColumn("_mixed", F.min("id_class").over(of_key) < F.max("id_class").over(of_key))
    mixed = written(mixed.where("_mixed").select("key", "id", F.col("id_class").alias("class")))
    release(members)
    rest = written(alike(between(mixed)).select("a", "b"))
    release(mixed)
    if rest.take(1):
        found = components(links.union(rest))
    release(links, rest)
    return found
