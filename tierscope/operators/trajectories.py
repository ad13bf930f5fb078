"""Reconstruction of multi-call trajectories from requests without ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import written


def with_group_key(requests: DataFrame) -> DataFrame:
    """``requests`` with ``key``, a fingerprint of system and first user text; null when both are empty."""
    texts = requests.withColumn("_sys", X.role_text(F.col("input"), "system")).withColumn("_usr", X.role_text(F.col("input"), "user"))
    return keyed(texts, "_sys", "_usr").drop("_sys", "_usr")


def keyed(df: DataFrame, system: str, user: str) -> DataFrame:
    joined = F.concat(F.coalesce(system, F.lit("")), F.lit("\0"), F.coalesce(user, F.lit("")))
    return df.withColumn("key", F.when(joined != "\0", F.substring(F.sha1(joined.cast("binary")), 1, 16)))


def with_hashes(requests: DataFrame) -> DataFrame:
    """``requests`` with ``hashes``: one for each item, equal for items equal as parsed JSON (key order aside)."""
    return requests.withColumn("hashes", F.transform("items_raw", lambda i: F.xxhash64(F.coalesce(F.to_json(F.try_parse_json(i)), i))))


def _parents(rows: pd.DataFrame) -> pd.DataFrame:
    """(pos, parent) of one range of requests in the order of (key, blob, pos): the last request before it that is equal or its longest prefix.

    In this order a request's prefixes come before it, so they are what is left on a stack from
    which everything that isn't a prefix goes; ``above`` has those of the range's first request.
    """
    rows = rows.sort_values(["key", "blob", "pos"], kind="stable")
    parents, key, stack = [], rows["key"].iloc[0], [(int(a["n"]), int(a["pos"]), None) for a in rows["above"].iloc[0]]
    first = rows["blob"].iloc[0]
    stack = [(n, pos, first[: 8 * n]) for n, pos, _ in stack]
    for pos, own, blob in zip(rows["pos"].tolist(), rows["key"], rows["blob"], strict=True):
        if own != key:
            key, stack = own, []
        while stack and not blob.startswith(stack[-1][2]):
            stack.pop()
        parents.append(stack[-1][1] if stack else None)
        if stack and stack[-1][2] == blob:
            stack.pop()
        stack.append((len(blob) // 8, pos, blob))
    return pd.DataFrame({"pos": rows["pos"].to_numpy(), "parent": pd.array(parents, "Int64")})


def _heads(rows: pd.DataFrame) -> pd.DataFrame:
    """(pos, head): a request that goes on with its parent's chain has its parent's head, any other one is a head."""
    rows = rows.sort_values(["key", "blob", "pos"], kind="stable")
    head: dict[int, int] = {}
    last = None
    for a in rows["above"].iloc[0]:  # from the shortest prefix to the longest
        last = head[int(a["pos"])] = last if a["goes_on"] and last is not None else int(a["first"])
    heads = []
    for pos, parent, goes_on in zip(rows["pos"].tolist(), rows["parent"].tolist(), rows["goes_on"].tolist(), strict=True):
        head[pos] = head[int(parent)] if goes_on else pos
        heads.append(head[pos])
    return pd.DataFrame({"pos": rows["pos"].to_numpy(), "n": rows["n"].to_numpy(), "key": rows["key"].to_numpy(), "head": heads})


def split_chains(requests: DataFrame) -> DataFrame:
    """(pos, n, key, head) of requests (pos, key, hashes, n): by length and place, each joins the chain whose tail is its longest prefix, or opens one.

    Only a request's parent, the last one before it that is equal or its longest prefix, can be
    a tail when it comes: whatever lies above the parent was taken over when the parent came. So
    of a parent's children the first by length and place goes on with its chain. Parents come from ranges
    of the requests in the order of their items, each of which starts with the prefixes of its
    first request; no range holds more than its share, however many requests an opening has.
    """
    blob = F.unhex(F.array_join(F.transform("hashes", lambda h: F.lpad(F.hex(h), 16, "0")), ""))
    rows = requests.select("pos", "key", "n", blob.alias("blob")).repartitionByRange("key", "blob")
    placed = written(rows.withColumn("part", F.spark_partition_id()), "requests")
    # The prefixes of each range's first request, a few lookups for each range.
    first = placed.groupBy("part").agg(F.min(F.struct("key", "blob")).alias("f")).select("part", "f.*")
    at = F.sequence(F.lit(0), F.shiftright(F.octet_length("blob"), 3) - 1)
    looked = first.filter(F.octet_length("blob") > 0).select("part", "key", F.col("blob").alias("_whole"), F.explode(at).alias("_n")).select("part", "key", F.substring("_whole", F.lit(1), 8 * F.col("_n")).alias("blob"))
    mark = lambda df: df.withColumn("_h", F.xxhash64("key", "blob"))
    above = mark(placed.select("key", "blob", "n", "pos")).join(mark(looked).select("part", "_h", F.col("key").alias("_k"), F.col("blob").alias("_b")), "_h").filter((F.col("key") == F.col("_k")) & (F.col("blob") == F.col("_b")))
    above = written(above.groupBy("part", "n").agg(F.max("pos").alias("pos"), F.min("pos").alias("first")), "prefixes")  # of equal requests the last and the first
    ordered = lambda df, *cols: df.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", "pos", *cols))).alias("above"))
    none = lambda col: F.coalesce(F.col("above"), F.array().cast(col))
    parents = placed.join(F.broadcast(ordered(above)), "part", "left").withColumn("above", none("array<struct<n:int,pos:bigint>>")).groupBy("part").applyInPandas(_parents, "pos long, parent long")
    linked = written(placed.join(parents, "pos"), "linked")
    child = linked.filter("parent is not null").groupBy("parent").agg(F.min(F.struct("n", "pos")).alias("c")).select(F.col("c.pos").alias("pos"), F.lit(True).alias("goes_on"))
    flagged = linked.join(child, "pos", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    known = ordered(above.join(child.withColumnRenamed("pos", "first"), "first", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))), "first", "goes_on")
    return flagged.join(F.broadcast(known), "part", "left").withColumn("above", none("array<struct<n:int,pos:bigint,first:bigint,goes_on:boolean>>")).groupBy("part").applyInPandas(_heads, "pos long, n int, key string, head long")


def chain_heads(requests: DataFrame) -> DataFrame:
    """(pos, n, key, head) of requests (pos, key, hashes): each with the first request of its chain.

    A group whose requests nest one in the next, in order of length, is one chain: a window
    tells that without moving any text. Only the other groups go through the greedy split, on
    their hashes alone. Requests without a key are trajectories of their own.
    """
    rows = requests.select(F.col("pos").cast("long").alias("pos"), "key", "hashes", F.size("hashes").alias("n"))
    order = Window.partitionBy("key").orderBy("n", "pos")
    with_key = rows.filter(F.col("key").isNotNull()).withColumn("_before", F.lag("hashes").over(order))
    nests = F.col("_before").isNull() | (F.slice("hashes", 1, F.greatest(F.size("_before"), F.lit(0))) == F.col("_before"))
    checked = with_key.withColumn("_nests", F.min(nests).over(Window.partitionBy("key"))).drop("_before")
    head = F.first("pos").over(Window.partitionBy("key").orderBy("n", "pos"))
    plain = checked.filter("_nests").withColumn("head", head).select("pos", "n", "key", "head")
    split = checked.filter("not _nests").select("pos", "key", "hashes", "n")
    split = split_chains(split)
    solo = rows.filter(F.col("key").isNull()).select("pos", "n", "key", F.col("pos").alias("head"))
    return plain.unionByName(split).unionByName(solo)


def reconstruct(requests: DataFrame) -> DataFrame:
    """(pos, trajectory_id, call_index, request_id, trajectory_key, group_key) of requests (pos, key, hashes): chains by the place of their heads."""
    members = chain_heads(requests)
    members = members.withColumn("call_index", F.row_number().over(Window.partitionBy("head").orderBy("n", "pos")))

    # Dense ids on the table of chain heads: counts of runs of 65,536 places, then places within a run.
    heads = members.groupBy("head", "key").agg(F.count(F.lit(1)).alias("size"))
    run = F.shiftright("head", 16)
    within = Window.partitionBy("_run").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_run", run).withColumn("_in", F.coalesce(F.count(F.lit(1)).over(within), F.lit(0))).withColumn("_calls", F.coalesce(F.sum("size").over(within), F.lit(0)))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = heads.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"), F.count_if(F.col("key").isNull()).alias("_solo"))
    runs = runs.select("_run", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_s", "_solo")])
    nth_solo = F.count_if(F.col("key").isNull()).over(within)
    nth_key = F.row_number().over(Window.partitionBy("key").orderBy("head"))
    numbered = heads.withColumn("_nth_solo", F.coalesce(nth_solo, F.lit(0))).withColumn("_nth", nth_key).join(runs, "_run")
    name = F.when(F.col("key").isNull(), F.concat(F.lit("solo:"), F.col("_solo_before") + F.col("_nth_solo"))).when(F.col("_nth") == 1, F.col("key")).otherwise(F.concat_ws(".", "key", F.col("_nth") - 1))
    numbered = numbered.select("head", (F.col("_n_before") + F.col("_in") + 1).alias("trajectory_id"), (F.col("_s_before") + F.col("_calls")).alias("_calls_before"), name.alias("trajectory_key"))
    return members.join(numbered, "head").select("pos", "trajectory_id", "call_index", (F.col("_calls_before") + F.col("call_index")).alias("request_id"), "trajectory_key", F.col("key").alias("group_key"))


def link(requests: DataFrame, chains: DataFrame) -> DataFrame:
    return requests.join(chains.select("pos", "request_id", "trajectory_id", "call_index", "trajectory_key"), "pos")


def reconstruction_stats(chains: DataFrame) -> DataFrame:
    """One row: requests, trajectories, empty-key requests, split groups, calls a trajectory (least, upper median, most)."""
    sizes = chains.groupBy("trajectory_id", "group_key").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.filter(F.col("group_key").isNotNull()).groupBy("group_key").agg(F.count(F.lit(1)).alias("chains"))
    # The upper median from the histogram of sizes.
    tally = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))
    middle = tally.select("n", upto.alias("upto"), total.alias("total")).filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("calls_median"))
    one = sizes.agg(F.sum("n").alias("n_requests"), F.count(F.lit(1)).alias("n_trajectories"), F.sum(F.when(F.col("group_key").isNull(), F.col("n")).otherwise(0)).alias("n_singleton_empty_key"), F.min("n").alias("calls_min"), F.max("n").alias("calls_max"))
    return one.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(groups.agg(F.count_if(F.col("chains") > 1).alias("n_groups_split"))))


def mixed_models(linked: DataFrame) -> DataFrame:
    return linked.groupBy("trajectory_id").agg(F.count_distinct("model").alias("models")).filter("models > 1")


def model_totals(linked: DataFrame, tokens: str) -> DataFrame:
    return linked.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))


def first_and_deepest(linked: DataFrame, call: list[str], size: str = "n_items") -> DataFrame:
    """(trajectory_id, first, deepest, n_calls, model): the earliest and the deepest call as structs of ``call``."""
    order = F.struct(F.coalesce("call_index", F.lit(0)), size)
    whole = F.struct(*call)
    return linked.groupBy("trajectory_id").agg(F.min_by(whole, order).alias("first"), F.max_by(whole, order).alias("deepest"), F.count(F.lit(1)).alias("n_calls"), F.max_by("model", order).alias("model"))


def multi_call(linked: DataFrame) -> DataFrame:
    """Requests of trajectories with two calls or more."""
    many = linked.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("trajectory_id")
    return linked.join(many, "trajectory_id", "left_semi")


def recovered_replies(linked: DataFrame) -> DataFrame:
    """(trajectory_id, call_index, reply): model items that the next call adds, as JSON of 4,000 characters; null without."""
    order = Window.partitionBy("trajectory_id").orderBy("call_index")
    nxt = linked.withColumn("_raw", F.lead("items_raw").over(order)).withColumn("_items", F.lead("input").over(order))
    beyond = F.sequence(F.size("input") + 1, F.size("_items"))
    added = F.when(F.size("_items") > F.size("input"), F.filter(beyond, lambda k: F.coalesce(F.element_at("_items", k)["role"] == "assistant", F.lit(False)) | F.coalesce(F.element_at("_items", k)["type"].isin(*X.CALLS), F.lit(False))))
    texts = F.transform(added, lambda k: F.element_at("_raw", k))
    return nxt.select("trajectory_id", "call_index", F.when(F.size(added) > 0, F.substring(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")), 1, 4000)).alias("reply"))


def trigger_kind(linked: DataFrame) -> DataFrame:
    """``linked`` with ``mechanical``: whether the item before the last is a tool output."""
    before = F.try_element_at("input", F.lit(-2))
    return linked.withColumn("mechanical", F.coalesce((F.size("input") > 1) & before["type"].isin(*X.OUTPUTS), F.lit(False)))


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Group keys that both logs hold."""
    return a.select("key").filter("key is not null").intersect(b.select("key"))
