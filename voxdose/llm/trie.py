"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns; its key is the xor, over its turns, of two 64-bit hashes of (place, turn),
so that the keys of all prefixes come from one running xor and the key of the parent needs no lookup. A node is named by its
smallest member and its depth. Texts are hashed where they are read: only hashes, counts and places are shuffled.

Roll-up. Each node weighs as much as it has members, so a subtree weighs as much as its members have turns at or below its
top: a grouping of members gives all weights. ``rest`` is the weight of what hangs below a node in its component. In each round
every component is split at its centroid, the deepest node with at least half of the component's weight; the nodes of at least
half the weight are then just the path from the centroid to the component's top. The totals of what hangs below the centroid
are aggregated once for each component and added along that path, whose nodes lose the centroid's weight. The
centroid leaves, the subtrees of its children become components of their own, and the rest goes on as it is. No piece weighs over half
of what it came from, so the number of rounds grows with the logarithm of the number of turns, however deep the trie is.
A node finds the child of the centroid that it hangs below by the path of its own smallest member, one lookup by (conversation, depth).

Turns of equal number are ordered by role, then by the hash of role and text. Null turns come first; a null role or text is empty;
repeated rows are repeated turns. Rows without a conv_id belong to no conversation and are left out. Conversations that are rebuilt to
nothing are members of the root alone. An empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Components up to which what is known of each is broadcast.
BROADCAST = 200_000
#: Conversations start with turns of the first of so many, and with so many turns at most.
FAMILY, SHARED = 20, 4
#: A piece of a list of ends holds conv_ids that are alike but for so many last bits.
PIECE_BITS = 12
VALUES = ("leaves", "saved")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, r (place from 1), t (hash of role and text), words."""
    role, text = text_of("role"), text_of("text")
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("t"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t")
    return narrow.select("conv_id", F.row_number().over(order).alias("r"), "t", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations with their number of turns (conv_id, n), and their turns (conv_id, n, depth, t, words), once they start like their family's first one."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where((F.col("conv_id") == first) & (F.col("r") < SHARED)).groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("r", "t", "words"))).alias("head"))  # at most 3 turns
    each = own.groupBy("conv_id").agg(F.max("r").alias("had")).select("conv_id", "had", shared.alias("shared"), first.alias("first")).join(heads, "first", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<r:int,t:binary,words:bigint>>")), F.lit(1), F.col("shared"))
    each = each.withColumn("head", head).withColumn("n", (F.size("head") + F.greatest(F.col("had") - F.col("shared"), F.lit(0))).cast("bigint"))
    each = stored(each.select("conv_id", "shared", "head", "n"))
    begun = each.select("conv_id", "n", F.explode("head").alias("h")).select("conv_id", "n", F.col("h.r").cast("bigint").alias("depth"), "h.t", "h.words")
    went_on = own.join(each, "conv_id").where(F.col("r") > F.col("shared")).select("conv_id", "n", (F.size("head") + F.col("r") - F.col("shared")).cast("bigint").alias("depth"), "t", "words")
    return each.select("conv_id", "n"), begun.unionByName(went_on)


def prefixes(members: DataFrame) -> DataFrame:
    """Each conversation's nodes below the root: conv_id, n, depth, words, k1 and k2 (the node's key)."""
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    lane = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("depth"), F.col("t"))).over(along)
    return members.select("conv_id", "n", "depth", "words", lane(1).alias("k1"), lane(2).alias("k2"))


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (owner, depth, up, n_convs, weight, words), paths (conv_id, depth, owner, up) and ends (owner, depth, conv_id).

    ``owner`` is a node's smallest member, ``up`` that of its parent (the root: null).
    """
    each, members = rebuilt(stored(turns(conversations)))
    keyed = stored(prefixes(members))
    root = each.agg(F.min("conv_id"), F.count("*"), F.sum(F.col("n") + 1)).first()
    key = ["depth", "k1", "k2"]
    named = keyed.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), F.min("words").alias("words"))
    placed = stored(keyed.select("conv_id", "n", *key).join(named, key).select("conv_id", "n", "depth", "owner", "n_convs", "weight", "words"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    paths = stored(placed.withColumn("up", F.coalesce(F.lag("owner").over(along), F.lit(root[0]).cast("bigint"))))
    top = each.limit(0).sparkSession.createDataFrame([(root[0], 0, None, root[1], root[2], 0)] if root[1] else [], "owner bigint, depth bigint, up bigint, n_convs bigint, weight bigint, words bigint")
    nodes = paths.where("conv_id = owner").select(*top.columns).unionByName(top)
    ends = paths.where("n = depth").select("owner", "depth", "conv_id").unionByName(each.where("n = 0").select(F.lit(root[0]).cast("bigint").alias("owner"), F.lit(0).cast("bigint").alias("depth"), "conv_id"))
    return nodes, paths.select("conv_id", "depth", "owner", "up"), ends


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def rolled_up(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """owner, depth and the sums of ``VALUES`` over each node's subtree.

    ``nodes``: owner, depth, weight (of the whole subtree) and ``VALUES``, one row a node, ``paths`` as from ``trie``.
    ``rest`` is kept in the rows, so a round reads nothing but the rows that are left.
    """
    top = nodes.agg(F.min_by("owner", "depth")).first()[0]
    begun = [F.lit(top).cast("bigint").alias("c_owner"), F.lit(0).cast("bigint").alias("c_depth")]
    left = stored(nodes.select("owner", "depth", F.col("weight").alias("rest"), *VALUES, *[F.lit(0).cast("bigint").alias(f"more_{v}") for v in VALUES], *begun))
    comp, out = ["c_owner", "c_depth"], []
    own_path = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") - 1).alias("cut_depth"), F.col("owner").alias("child"), F.col("up").alias("cut_found"))
    while True:
        tops = stored(left.groupBy(*comp).agg(F.max("rest").alias("whole")))
        n = tops.count()
        if not n:
            break
        halves = left.join(_few(tops, n), comp).where(2 * F.col("rest") >= F.col("whole"))
        cuts = stored(halves.groupBy(*comp, "whole").agg(F.max(F.struct("depth", "owner", "rest")).alias("cut")).select(*comp, "whole", F.col("cut.depth").alias("cut_depth"), F.col("cut.owner").alias("cut_owner"), F.col("cut.rest").alias("cut_rest")))
        seen = left.join(_few(cuts, n), comp)
        # below the centroid's depth a node looks for the centroid's child on its own path; others cannot hang below it
        deep = seen.where(F.col("depth") > F.col("cut_depth")).join(own_path, ["owner", "cut_depth"])
        deep = deep.withColumn("child", F.when(F.col("cut_found") == F.col("cut_owner"), F.col("child"))).drop("cut_found")
        high = seen.where(F.col("depth") <= F.col("cut_depth")).withColumn("child", F.lit(None).cast("bigint"))
        split = stored(deep.unionByName(high.select(*deep.columns)))
        is_cut = (F.col("depth") == F.col("cut_depth")) & (F.col("owner") == F.col("cut_owner"))
        below = split.where(is_cut | F.col("child").isNotNull()).groupBy(*comp).agg(*[F.sum(v).alias(f"all_{v}") for v in VALUES])
        summed = split.join(_few(below, n), comp)
        on_path = (F.col("depth") <= F.col("cut_depth")) & (2 * F.col("rest") >= F.col("whole"))
        summed = summed.select(
            "owner",
            "depth",
            F.when(on_path & ~is_cut, F.col("rest") - F.col("cut_rest")).otherwise(F.col("rest")).alias("rest"),
            *VALUES,
            *[(F.col(f"more_{v}") + F.when(is_cut, F.col(f"all_{v}") - F.col(v)).when(on_path, F.col(f"all_{v}")).otherwise(F.lit(0))).alias(f"more_{v}") for v in VALUES],
            F.coalesce("child", "c_owner").alias("c_owner"),
            F.when(F.col("child").isNotNull(), F.col("cut_depth") + 1).otherwise(F.col("c_depth")).alias("c_depth"),
            is_cut.alias("done"),
        )
        summed = stored(summed)
        out.append(summed.where("done"))
        left = summed.where("not done").drop("done")
    rows = out[0] if out else left
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.select("owner", "depth", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in VALUES])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest for each run of pieces of one node; the rows come in order, and nothing but the running digest is held."""
    at, digest, out = None, None, []
    for b in batches:
        for owner, depth, piece in zip(b["owner"], b["depth"], b["piece"], strict=True):
            if (owner, depth) != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (owner, depth), hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if out:
            yield pd.DataFrame(out, columns=["owner", "depth", "ends_sha256"])
            out = []
    if at is not None:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["owner", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: of the ascending conv_ids that end at a node. Lists are made in pieces of a range of ids, then hashed as they stream by."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("owner", "depth", F.shiftright("conv_id", PIECE_BITS).alias("at")).agg(text.alias("piece"))  # at most 2 ** PIECE_BITS ids
    ordered = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "at").select("owner", "depth", "piece")
    return ordered.mapInPandas(_hashed, "owner bigint, depth bigint, ends_sha256 string")


def op11(conversations: DataFrame) -> DataFrame:
    nodes, paths, ends = trie(conversations)
    below = nodes.where("depth > 0").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(below, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    leaf: Column = (F.col("n_children") == 0).cast("bigint")
    valued = stored(valued.withColumn("leaves", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    sums = rolled_up(valued.select("owner", "depth", "weight", *VALUES), paths)
    x = valued.drop(*VALUES).join(sums, ["owner", "depth"]).join(end_digests(ends), ["owner", "depth"], "left")
    return x.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
