"""The tables of one source folder, each built lazily and once per instance."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwright.operators.running import RANGE, dealt
from cartwright.plans import marts, staging
from cartwright.plans.history import order_history, targets, training_dataset
from cartwright.session import settle
from cartwright.sources import shop

MATERIALISED = ("fct_orders", "dim_products", "feature_store")


class Warehouse:
    """Lazy plans by default; ``materialise`` writes the shared marts so later plans only read them."""

    def __init__(self, spark: SparkSession, root: str, categories=shop.SHOP_CATEGORIES):
        self.spark, self.root, self.categories = spark, root, categories
        self._tables: dict[str, DataFrame] = {}

    def materialise(self, folder: str) -> Warehouse:
        for name in MATERIALISED:
            path = f"{folder}/{name}"
            getattr(self, name).write.mode("overwrite").parquet(path)
            self.__dict__[name] = self.spark.read.parquet(path)
        return self

    def raw(self, name: str) -> DataFrame:
        """A source table; its schema is read once."""
        if name not in self._tables:
            self._tables[name] = shop.table(self.spark, self.root, name)
        return self._tables[name]

    @cached_property
    def order_base(self) -> DataFrame:
        return shop.order_base(self.raw("orders"))

    @cached_property
    def raw_products(self) -> DataFrame:
        return shop.raw_products(self.raw("part"))

    @cached_property
    def raw_order_products(self) -> DataFrame:
        return shop.raw_order_products(self.raw("lineitem"))

    @cached_property
    def timelines(self) -> DataFrame:
        """Staged orders with their range of (user, order number)."""
        numbered = shop.number_orders(self.order_base)
        return staging.stg_orders(numbered, keep=[RANGE])

    @cached_property
    def stg_orders(self) -> DataFrame:
        return self.timelines.drop(RANGE)

    @cached_property
    def stg_order_products(self) -> DataFrame:
        return staging.stg_order_products(self.raw_order_products)

    @cached_property
    def stg_products(self) -> DataFrame:
        return staging.stg_products(
            self.raw_products, shop.raw_aisles(self.raw("part")), shop.raw_departments(self.raw("part"))
        )

    @cached_property
    def stg_customers(self) -> DataFrame:
        return staging.stg_customers(self.stg_orders)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.stg_orders, self.stg_order_products)

    @cached_property
    def dealt_facts(self) -> DataFrame:
        """The order fact with the ranges of its timelines, so that scans along them need no new dealing. Lines of an
        order lie far apart in their file, so they are dealt before they are grouped, not combined per split of the file."""
        lines = self.stg_order_products.select("order_id", "add_to_cart_order", "reordered")
        return marts.fct_orders(self.timelines, dealt(lines, "order_id"))

    @cached_property
    def stored_facts(self) -> DataFrame:
        """``dealt_facts`` as a table, for plans that read it several times."""
        return settle(self.dealt_facts)

    @cached_property
    def shelves(self) -> DataFrame:
        """Product attributes, a projection of their own rows: the file's size tells the planner whether to
        broadcast them, so the lines are not shuffled by product first to find out."""
        return marts.product_categories(shop.shelves(self.raw("part")))

    @cached_property
    def dim_products(self) -> DataFrame:
        return marts.dim_products(self.stg_products, self.stg_order_products)

    @cached_property
    def dim_users(self) -> DataFrame:
        return marts.dim_users(self.fct_orders)

    @cached_property
    def feature_store(self) -> DataFrame:
        return marts.feature_store(self.fct_orders, self.stg_order_products, self.shelves, self.categories)

    @cached_property
    def churn(self) -> DataFrame:
        return marts.churn_probability(self.feature_store)

    @cached_property
    def lifetime_value(self) -> DataFrame:
        return marts.lifetime_value(self.feature_store)

    @cached_property
    def cohorts(self) -> DataFrame:
        return marts.cohort_retention(self.fct_orders)

    @cached_property
    def training(self) -> DataFrame:
        return training_dataset(self.stored_facts, self.stg_order_products, self.shelves, self.categories)

    @cached_property
    def scored(self) -> DataFrame:
        """Target orders with a deterministic score in [0, 1]: the prior reorder ratio, an order feature."""
        rows = targets(order_history(self.dealt_facts))
        return settle(rows.select(
            "user_id", "order_id", F.col("will_reorder").alias("label"), F.col("reorder_ratio").alias("score")
        ))
