"""Inventories of stores, orphans, removal, migration and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Migration strategies from the least work to the most.
STRATEGIES = ["none", "metadata_only", "re_extract", "kg_reextract", "full_phase2"]


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """added, deleted, modified or unchanged for each key of two inventories."""
    a, b = old.select(key, F.col(content).alias("old_")), new.select(key, F.col(content).alias("new_"))
    change = F.when(F.col("old_").isNull(), "added").when(F.col("new_").isNull(), "deleted").when(F.col("old_") != F.col("new_"), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def inventory(manifest: DataFrame, stores: dict[str, DataFrame], key: str = "source_key") -> DataFrame:
    """(store, key) of the manifest's rows that aren't deleted, and of each store."""
    rows = manifest.filter(~F.coalesce("deleted", F.lit(False))).select(F.lit("manifest").alias("store"), key)
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(name).alias("store"), key) for name, df in stores.items()], rows).distinct()


def orphans(inventoried: DataFrame, key: str = "source_key") -> DataFrame:
    """(kind, key): keys of a store that the manifest hasn't, and manifest keys that no store has.

    One aggregation over the keys instead of an anti join a store.
    """
    held = inventoried.groupBy(key).agg(F.collect_set("store").alias("stores"))  # the stores are few
    known = F.array_contains("stores", "manifest")
    lost = held.filter(~known).select(F.explode("stores").alias("store"), key).select(F.concat(F.col("store"), F.lit("_orphan")).alias("kind"), key)
    return lost.unionByName(held.filter(known & (F.size("stores") == 1)).select(F.lit("manifest_only").alias("kind"), key))


def collect_garbage(manifest: DataFrame, doomed: DataFrame, mode: str, now: Column, key: str = "source_key") -> DataFrame:
    """soft: mark the doomed keys deleted at `now`; hard: remove them."""
    if mode == "hard":
        return manifest.join(doomed.select(key), key, "left_anti")
    marked = manifest.join(doomed.select(key, F.lit(True).alias("doomed_")), key, "left")
    return marked.withColumn("deleted_at", F.when(F.col("doomed_"), now).otherwise(F.col("deleted_at"))).withColumn("deleted", F.coalesce("doomed_", "deleted")).drop("doomed_")


def expired(manifest: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Deleted rows whose time is over; times that can't be read never are."""
    at = F.try_to_timestamp("deleted_at")
    return manifest.filter(F.col("deleted") & (at < now - F.make_dt_interval(F.lit(days))))


def plan_migration(manifest: DataFrame, changelog: DataFrame, target: str) -> DataFrame:
    """source_key, from_version, strategy: the most work of any version after the entry's, up to the target.

    changelog: place, version, strategy; it is a short, hand-written list, joined by a range.
    """
    place = F.when(F.lit(False), 0)
    for i, s in enumerate(STRATEGIES):
        place = place.when(F.col("strategy") == s, i)
    log = changelog.withColumn("rank", place)
    own = log.select(F.col("version").alias("schema_version"), F.col("place").alias("from_place"))
    to = log.filter(F.col("version") == target).select(F.col("place").alias("to_place"))
    due = manifest.filter(~F.coalesce("deleted", F.lit(False)) & (F.col("schema_version") != target)).join(F.broadcast(own), "schema_version", "left").crossJoin(F.broadcast(to))
    steps = due.join(F.broadcast(log.select("place", "rank")), (F.col("place") > F.col("from_place")) & (F.col("place") <= F.col("to_place")), "left")
    worst = steps.groupBy("source_key", "schema_version", "from_place", "to_place").agg(F.max("rank").alias("rank"))
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    strategy = F.when(F.col("from_place").isNull(), "metadata_only").when(F.col("from_place") > F.col("to_place"), "none").otherwise(F.get(names, F.coalesce("rank", F.lit(0))))
    return worst.select("source_key", F.col("schema_version").alias("from_version"), strategy.alias("strategy"))


def matched_entries(sources: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """For each source the entry that its first matching key names, keys in their order of priority.

    Both sides are unpivoted into (place of the key, value), so one join serves all keys.
    """
    spread = lambda df, own: df.select(own, F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("place", "value")).filter("value is not null")
    hits = spread(sources, "source").join(spread(manifest, "entry"), ["place", "value"])
    best = hits.groupBy("source").agg(F.min(F.struct("place", "entry")).alias("b")).select("source", F.col("b.entry").alias("entry"), F.col("b.place").alias("matched_by"))
    return sources.select("source").join(best, "source", "left")


def consistency(manifest: DataFrame, counts: dict[str, DataFrame | None], key: str = "trace_id") -> DataFrame:
    """Per trace whether each store holds it (null: the store isn't configured), and whether all do."""
    out = manifest.select(key)
    for name, df in counts.items():
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("boolean"))
        else:
            out = out.join(df.groupBy(key).agg(F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("consistent", reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit(True)) for n in counts]))
