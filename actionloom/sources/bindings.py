"""Views that present the generic test tables as an interaction log.

Used by the registered queries, the tests and the benchmark. The operators never see
these names: they take any log with the columns of ``FeatureSpec``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionloom.operators.assemble import attach
from actionloom.functions.signals import watch_signals
from actionloom.spec import ACTIONS_ALL, FeatureSpec

# The event table spans thirty days; the last one is scored, the one before validates.
EVENTS_SPEC = FeatureSpec(last_day=30)
# The order tables as a second, larger log: several years of days.
ORDERS_SPEC = FeatureSpec(last_day=2406)
VECTOR_LENGTH = 64

PREDICTION_SCALE = {
    "read_comment": (13, 1000), "like": (26, 1000), "click_avatar": (39, 100), "forward": (52, 10),
    "favorite": (65, 1000), "comment": (78, 100), "follow": (91, 10),
}


@dataclass
class Tables:
    """The test tables of one scale, bound lazily."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def interactions(self) -> DataFrame:
        is_type = lambda t: (F.col("event_type") == t).cast("int")
        every = lambda n: (F.col("event_id") % n == 0).cast("int")
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("userid"),
            F.get_json_object("props", "$.k").cast("long").alias("feedid"),
            (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("date_"),
            ((F.col("event_id") % 2).cast("int") + 1).alias("device"),
            is_type("view").alias("read_comment"),
            every(11).alias("comment"),
            is_type("click").alias("like"),
            (F.col("value") * 1000).alias("play"),
            ((F.col("value") + F.col("event_id") % 7) * 1000).alias("stay"),
            is_type("signup").alias("click_avatar"),
            is_type("purchase").alias("forward"),
            every(13).alias("follow"),
            every(17).alias("favorite"),
        )

    def items(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        text = lambda c: c.cast("string")
        unless = lambda n, value: F.when(key % n != 0, value)
        return self.raw("part").select(
            key.alias("feedid"),
            F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("authorid"),
            F.when(key % 31 == 0, F.lit(0.0)).when(key % 19 == 0, F.lit(None))
            .otherwise(size.cast("double")).alias("videoplayseconds"),
            unless(7, key % 23).alias("bgm_song_id"),
            unless(5, key % 11).alias("bgm_singer_id"),
            unless(4, F.concat_ws(";", text(key % 37), text(key % 17))).alias("manual_keyword_list"),
            unless(6, F.concat_ws(";", text(key % 17), text(size))).alias("machine_keyword_list"),
            unless(5, text(key % 13)).alias("manual_tag_list"),
            unless(8, F.concat(text(key % 13 + 1), F.lit(" 0.6;"), text(size % 9), F.lit(" 0.75;"),
                               text(key % 7), F.lit(" 0.2"))).alias("machine_tag_list"),
        )

    def train(self) -> DataFrame:
        return self.interactions().filter(F.col("date_") < EVENTS_SPEC.last_day)

    def scoring(self) -> DataFrame:
        """The last day without labels and watch times."""
        return self.interactions().filter(F.col("date_") == EVENTS_SPEC.last_day).select(
            "event_id", "userid", "feedid", "device"
        )

    def watched(self) -> DataFrame:
        """Training rows with author, song and watch signals."""
        items = self.items().select("feedid", "authorid", "bgm_song_id", "videoplayseconds")
        return watch_signals(attach(self.train(), items, ["feedid"]))

    def packed_vectors(self) -> DataFrame:
        whole = lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")
        return self.raw("embeddings").select(
            F.col("vec_id").alias("feedid"),
            F.array_join(F.transform("embedding", whole), " ").alias("feed_embedding"),
        )

    def predictions(self, actions: tuple[str, ...] = ACTIONS_ALL) -> DataFrame:
        """The log with one deterministic prediction ``p_{action}`` per action; many ties."""
        score = lambda a: (
            ((F.col("event_id") * 7919 + PREDICTION_SCALE[a][0]) % PREDICTION_SCALE[a][1]).cast("double")
            / PREDICTION_SCALE[a][1]
        )
        return self.interactions().select("*", *[score(a).alias(f"p_{a}") for a in actions])

    def labels_per_pair(self, actions: tuple[str, ...]) -> DataFrame:
        return self.interactions().groupBy("userid", "feedid").agg(*[F.max(a).alias(a) for a in actions])

    def submission_per_pair(self, actions: tuple[str, ...]) -> DataFrame:
        return self.predictions(actions).groupBy("userid", "feedid").agg(
            *[F.max(f"p_{a}").alias(a) for a in actions]
        )

    def order_log(self) -> DataFrame:
        """Order lines as interactions: customers are users, parts items, suppliers authors."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        line = lambda n: (F.col("l_linenumber") == n).cast("int")
        return lines.select(
            F.col("o_custkey").alias("userid"),
            F.col("l_partkey").alias("feedid"),
            F.col("l_suppkey").alias("authorid"),
            (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) + 1).alias("date_"),
            (F.col("l_quantity") * 1000).alias("play"),
            ((F.col("l_quantity") + F.col("l_linenumber")) * 1000).alias("stay"),
            (F.col("l_returnflag") == "R").cast("int").alias("read_comment"),
            (F.col("l_returnflag") == "A").cast("int").alias("like"),
            (F.col("l_linestatus") == "O").cast("int").alias("click_avatar"),
            line(1).alias("forward"), line(2).alias("favorite"), line(3).alias("comment"),
            line(4).alias("follow"),
            F.col("l_discount").alias("p_like"), F.col("l_tax").alias("p_click_avatar"),
        )

    def order_items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("feedid"), F.col("p_size").cast("double").alias("videoplayseconds")
        )

    def watched_orders(self) -> DataFrame:
        return watch_signals(attach(self.order_log(), self.order_items(), ["feedid"]))
