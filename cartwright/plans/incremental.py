"""Incremental order fact: stored by ranges of order ids, changed by commits.

A manifest knows every range's folder and its highest id, so the high-water mark needs no scan, and a changed
order rewrites the folder of its range alone. Readers see all of a merge or nothing of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwright.plans.marts import fct_orders
from cartwright.session import settle
from cartwright.sources.published import Published

#: Order ids per stored range.
IDS_PER_RANGE = 1_000_000


def new_facts(orders: DataFrame, lines: DataFrame, mark: int) -> DataFrame:
    """Facts of the orders above the mark; only their lines are aggregated."""
    fresh = orders.where(F.col("order_id") > mark)
    # The mark bounds the lines before the semi join, which then removes lines without an order.
    own = lines.where(F.col("order_id") > mark).join(fresh.select("order_id"), "order_id", "left_semi")
    return fct_orders(fresh, own)


def changed_facts(orders: DataFrame, lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Facts of the given order ids, which the high-water mark would never revisit."""
    return fct_orders(orders.join(keys, "order_id", "left_semi"), lines.join(keys, "order_id", "left_semi"))


def upsert(existing: DataFrame, changed: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows of ``changed`` replace or join ``existing``; columns of either side are kept."""
    kept = existing.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


class FactTable:
    """The order fact under one folder."""

    def __init__(self, spark: SparkSession, root: str, ids_per_range: int = IDS_PER_RANGE) -> None:
        self.table, self.width = Published(spark, root), ids_per_range

    def read(self) -> DataFrame:
        return self.table.read()

    def mark(self) -> int:
        """The highest stored id, from the manifest."""
        return max((part["highest"] or 0 for part in self.table.manifest()["parts"]), default=0)

    def merge(self, changed: DataFrame) -> list[int]:
        """Replace or add orders by id; returns the ranges that were rewritten.

        Only the stored rows of touched ranges are read. They are written to new folders beside the old
        ones, and one commit exchanges them.
        """
        ranged = F.coalesce(F.floor(F.col("order_id") / self.width).cast("long"), F.lit(-1))
        changed = settle(changed)
        # One row per touched range.
        touched = {r["part"] for r in changed.select(ranged.alias("part")).distinct().collect()}
        if not touched:
            return []
        current = self.table.manifest()
        old = [part for part in current["parts"] if part["range"] in touched]
        rows = upsert(self.table.read(old), changed) if old else changed
        staged = self.table.stage(rows.withColumn("_part", ranged).repartitionByRange("_part", "order_id"), by="_part")
        written = self.table.read([staged])
        facts = written.groupBy("_part").agg(F.max("order_id").alias("highest"), F.count(F.lit(1)).alias("rows")).collect()
        new = [
            {"folder": f"{staged['folder']}/_part={r['_part']}", "range": r["_part"], "highest": r["highest"], "rows": r["rows"]}
            for r in facts
        ]
        kept = [part for part in current["parts"] if part["range"] not in touched]
        # The number follows the manifest that was read: a merge in between is a conflict, not a loss.
        self.table.commit([*kept, *new], current["number"] + 1)
        return sorted(touched)

    def append_new(self, orders: DataFrame, lines: DataFrame) -> int:
        """Merge the orders above the mark; returns the mark used. A second run adds nothing."""
        mark = self.mark()
        self.merge(new_facts(orders, lines, mark))
        return mark

    def reprocess(self, orders: DataFrame, lines: DataFrame, keys: DataFrame) -> list[int]:
        """Recompute the given order ids."""
        return self.merge(changed_facts(orders, lines, keys))
