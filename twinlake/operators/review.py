"""What the user decides about groups, as tables; nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from twinlake import config as C
from twinlake.functions.assets import is_file


def default_review(ranked: DataFrame) -> DataFrame:
    """(group_id, asset_id, marked): all but the keeper are marked for deletion."""
    return ranked.select("group_id", "asset_id", (F.col("rank") > 1).alias("marked"))


def apply_edits(review: DataFrame, edits: DataFrame) -> DataFrame:
    """review after edits (seq, group_id, asset_id, action), the last one for an asset counting.

    Actions: toggle, keep_only (asset_id is kept, the rest of the group marked),
    keep_all and reset (for the group; asset_id null). Toggles since the last other
    action add up.
    """
    base, key = review.withColumn("initial", F.col("marked")), ["group_id", "asset_id"]
    # what holds for a whole group is one row a group, the last that does; a toggle goes to its own asset only
    last = F.max_by(F.struct("seq", "action", F.col("asset_id").alias("target")), "seq")
    whole = edits.where("action <> 'toggle'").groupBy("group_id").agg(last.alias("s"))
    base = base.join(whole, "group_id", "left")
    toggles = edits.where("action = 'toggle'").select("seq", *key)
    flips = base.select(*key, F.coalesce("s.seq", F.lit(-1)).alias("whole")).join(toggles, key)
    flips = flips.where("seq > whole").groupBy(*key).agg(F.count(F.lit(1)).alias("flips"))
    out = base.join(flips, key, "left")
    marked = (
        F.when(F.col("s.action") == "keep_only", F.col("asset_id") != F.col("s.target"))
        .when(F.col("s.action") == "keep_all", F.lit(False))
        .otherwise(F.col("initial"))
    )
    odd = F.coalesce("flips", F.lit(0)) % 2 == 1
    return out.select(*key, F.when(odd, ~marked).otherwise(marked).alias("marked"))


def keeps_nothing(review: DataFrame) -> DataFrame:
    """(group_id, keeps_nothing): whether every member is marked."""
    return review.groupBy("group_id").agg(F.bool_and("marked").alias("keeps_nothing"))


def visible(groups: DataFrame, kinds: list[int]) -> DataFrame:
    if not kinds:
        raise ValueError("at least one kind has to be shown")
    return groups.where(F.col("kind").isin(*kinds))


def deletion_plan(review: DataFrame, ranked: DataFrame, shown: DataFrame) -> DataFrame:
    """(asset_id, byte_size, sink) of the marked members of shown groups; library entries before files."""
    marked = review.where("marked").join(shown.select("group_id"), "group_id", "left_semi")
    bytes_of = ranked.select("group_id", "asset_id", "byte_size")
    plan = marked.join(bytes_of, ["group_id", "asset_id"]).select("asset_id", "byte_size").distinct()
    return plan.withColumn("sink", F.when(is_file(F.col("asset_id")), "file").otherwise("library"))


def survivors(ranked: DataFrame, deleted: DataFrame) -> DataFrame:
    """ranked without the deleted assets; groups of one go, the best of the rest becomes the keeper."""
    left = ranked.join(deleted.select("asset_id"), "asset_id", "left_anti").drop("rank")
    w = Window.partitionBy("group_id")
    left = left.withColumn("left", F.count(F.lit(1)).over(w)).where("left >= 2").drop("left")
    return left.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "position")))


def preview(ranked: DataFrame, shown: int = 4) -> DataFrame:
    """(group_id, asset_id, rank, more): the first members of each group and how many are not shown."""
    more = F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy("group_id")) - shown)
    return ranked.select("group_id", "asset_id", "rank", more.alias("more")).where(F.col("rank") <= shown)


def selection(plan: DataFrame) -> DataFrame:
    """Selected assets and their bytes."""
    return plan.agg(
        F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("selected_bytes")
    )


def kind_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"))


def kind_label(kind) -> F.Column:
    return F.element_at(F.array(*map(F.lit, C.KIND_NAMES)), kind + 1)
