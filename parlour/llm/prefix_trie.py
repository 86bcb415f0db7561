"""Operator 12: the trie of conversation prefixes, measured by the Euler-tour technique.

A node is a distinct sequence of first turns; it is named by its smallest member and its depth. The nodes that one
conversation names lie below one another, so the trie falls into paths, one a conversation at most. The tour enters a
node, goes on along its path, then through the paths that hang below it by ascending conversation, and exits. All arcs
between two places where the tour changes path follow one another at known steps; such runs, two a path or so, are the
elements of a linked list that is ranked by pointer jumping, in as many rounds as the logarithm of their number. The
ranks place every enter and exit arc; subtree sums are differences of prefix sums over the arcs.

Scale: texts are hashed where they are read and never shuffled. Positions and prefix names (sums of turn hashes) come
from running sums over ranges, siblings from neighbours in a global order, so neither a conversation with very many
turns nor a node with very many children or members is one task's work. The members that end at a node are joined to
strings range by range, and only these strings come together to be hashed, one after another.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlour.llm.common import dropped, n_partitions, written
from parlour.llm.ordered import neighbours, ranged, running

GROUP, HEADS = 5, 9  # conversation c takes its first turns from c - c % GROUP, crc32(c) % HEADS of them
PART = 1 << 32
STEP = 1 << 16  # arcs of one run that are listed from one row
JOINED_CHARS = 1 << 20  # identifiers joined in one string, about


def _unsigned_mod(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, pos, digest, n_bytes), the turns of the rebuilt conversations in the order (part, pos), and (conv) of all
    conversations, turnless ones included."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("conv"), "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    turns = written(running(ranged(slim, order, "op12-turns"), "conv", order[1:], pos=F.lit(1).cast("long")).select("conv", "pos", "digest", "n_bytes"), "op12-positions")
    convs = written(turns.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS), "op12-conversations")
    base = _unsigned_mod(F.col("conv"), GROUP)
    heads = turns.filter((base == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    takers = convs.filter((base != 0) & (F.col("h") > 0)).withColumn("base", F.col("conv") - base)
    borrowed = takers.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv", F.lit(0).alias("part"), "pos", "digest", "n_bytes")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    own = turns.filter((base == 0) | (F.col("pos") > head)).select("conv", F.lit(1).alias("part"), "pos", "digest", "n_bytes")
    return borrowed.unionByName(own), convs.select("conv")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, n_bytes, last): the name of each conversation's prefix of every depth and of the one before.

    A name is 128 bits, four sums modulo 2**32 of the prefix's turn hashes, each taken together with its depth; the
    root's name is all zero."""
    order = [F.col("conv"), F.col("part"), F.col("pos")]
    rows = running(ranged(rebuilt, order, "op12-rebuilt"), "conv", order[1:], depth=F.lit(1).cast("long"))
    rows = rows.withColumn("d", F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest"))))
    rows = written(rows.select("conv", "pid", "depth", "n_bytes", (F.col("depth") == F.col("depth_all")).alias("last"),
                               *[F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(4)]), "op12-turn-hashes")
    rows = running(rows, "conv", [F.col("depth")], **{f"s{i}": F.col(f"w{i}") for i in range(4)})
    both = lambda a, b: F.shiftleft(_unsigned_mod(a, PART), 32).bitwiseOR(_unsigned_mod(b, PART))
    s, w = [F.col(f"s{i}") for i in range(4)], [F.col(f"w{i}") for i in range(4)]
    return rows.select("conv", "depth", both(s[0], s[1]).alias("k1"), both(s[2], s[3]).alias("k2"),
                       both(s[0] - w[0], s[1] - w[1]).alias("p1"), both(s[2] - w[2], s[3] - w[3]).alias("p2"), "n_bytes", "last")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal names in sorted rows (k1, k2, conv) as (k1, k2, first, ids), the identifiers joined by commas."""
    held = None  # name, first, strings, characters
    for b in batches:
        if not len(b):
            continue
        out = []
        starts = b.index[(b[["k1", "k2"]] != b[["k1", "k2"]].shift()).any(axis=1)].tolist()
        k1, k2, conv = b["k1"].tolist(), b["k2"].tolist(), b["conv"].tolist()
        for i, j in zip(starts, [*starts[1:], len(b)]):
            ids = ",".join(map(str, conv[i:j]))
            if held and held[0] == (k1[i], k2[i]) and held[3] < JOINED_CHARS:
                held[2].append(ids)
                held[3] += len(ids)
            else:
                if held:
                    out.append((*held[0], held[1], ",".join(held[2])))
                held = [(k1[i], k2[i]), conv[i], [ids], len(ids)]
        yield pd.DataFrame(out, columns=["k1", "k2", "first", "ids"])
    if held:
        yield pd.DataFrame([(*held[0], held[1], ",".join(held[2]))], columns=["k1", "k2", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, ends_sha256) from rows sorted by (k1, k2, first), one string after another."""
    name, state = None, None
    for b in batches:
        out = []
        for k1, k2, ids in zip(b["k1"].tolist(), b["k2"].tolist(), b["ids"].tolist()):
            if name == (k1, k2):
                state.update(b",")
            else:
                if name:
                    out.append((*name, state.hexdigest()))
                name, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
    if name:
        yield pd.DataFrame([(*name, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv): SHA-256 of the ascending decimal identifiers, joined by commas."""
    n = n_partitions(ends.sparkSession)
    strings = (ends.repartitionByRange(n, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
               .mapInPandas(_joined, "k1 long, k2 long, first long, ids string"))
    return strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(_hashed, "k1 long, k2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, n_convs, n_bytes, ends_sha256), one row a node, written. The root is there unless there
    are no conversations."""
    rebuilt, convs = rebuilt_turns(conversations)
    rows = written(prefixes(rebuilt), "op12-prefixes")
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("k1", "k2").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
                                         F.min(F.struct("p1", "p2")).alias("p")).select("k1", "k2", "conv", "depth", "n_convs", "n_bytes", "p.p1", "p.p2")
    root = (convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
            .select(zero.alias("k1"), zero.alias("k2"), "conv", zero.alias("depth"), "n_convs", zero.alias("n_bytes"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")))
    ended = rows.filter("last").select("k1", "k2", "conv")
    turnless = convs.join(ended, "conv", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "conv")
    digests = end_digests(ended.unionByName(turnless))
    none = hashlib.sha256(b"").hexdigest()
    return written(nodes.unionByName(root).join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))), "op12-nodes")


def trie_paths(nodes: DataFrame) -> DataFrame:
    """(conv, top, bottom, up, at): each conversation's path of nodes, and the node (up, at) that it hangs below (null: the root's)."""
    paths = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"))
    named = nodes.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("conv").alias("up"))
    return written(paths.join(named, (F.col("p.p1") == F.col("n1")) & (F.col("p.p2") == F.col("n2")), "left")
                   .select("conv", "top", "bottom", "up", F.when(F.col("up").isNotNull(), F.col("top") - 1).alias("at")), "op12-paths")


def tour_runs(paths: DataFrame) -> DataFrame:
    """The elements of the tour's list: (c, d, next_c, next_d, n_arcs, top, bottom, exits, up), written.

    Element (c, -1) enters path c from ``top`` to ``bottom`` and exits it from there to depth ``exits`` (beyond the bottom:
    not at all); element (c, d) exits path c from depth d to ``exits``, after the paths that hang below node (c, d)."""
    order = [F.col("up"), F.col("at").desc(), F.col("conv")]
    hanging = neighbours(ranged(paths.filter(F.col("up").isNotNull()), order, "op12-hanging"), order, ["up", "at", "conv"], descending=("at",))
    is_own = lambda side: F.coalesce(F.col(f"{side}.up") == F.col("up"), F.lit(False))
    hanging = written(hanging.select("conv", "up", "at", "after", is_own("before").alias("has_before"), is_own("after").alias("has_after"),
                                     (is_own("after") & (F.col("after.at") == F.col("at"))).alias("has_sibling")), "op12-siblings")
    inner = lambda c: F.lit(c).cast("long")
    later = hanging.select("conv", F.when(F.col("has_sibling"), F.col("after.conv")).otherwise(F.col("up")).alias("later_c"),
                           F.when(F.col("has_sibling"), inner(-1)).otherwise(F.col("at")).alias("later_d"))
    ends = (hanging.filter(~(F.col("has_before") & F.col("has_after"))).groupBy(F.col("up").alias("conv"))
            .agg(F.max(F.when(~F.col("has_before"), F.col("conv"))).alias("child"), F.max(F.when(~F.col("has_before"), F.col("at"))).alias("deepest"),
                 F.max(F.when(~F.col("has_after"), F.col("at"))).alias("highest")))
    own = written(paths.join(later, "conv", "left").join(ends, "conv", "left"), "op12-path-ends")
    bears = F.col("child").isNotNull()
    exits = F.coalesce(F.col("deepest") + 1, F.col("top"))
    columns = ["c", "d", "next_c", "next_d", "n_arcs", "top", "bottom", "exits", "up"]
    down = own.select(F.col("conv").alias("c"), inner(-1).alias("d"), F.when(bears, F.col("child")).otherwise(F.col("later_c")).alias("next_c"),
                      F.when(bears, inner(-1)).otherwise(F.col("later_d")).alias("next_d"),
                      (F.col("bottom") - F.col("top") + 1 + F.col("bottom") - exits + 1).alias("n_arcs"), "top", "bottom", exits.alias("exits"), "up")
    none = inner(None)
    last = own.filter(bears).select(F.col("conv").alias("c"), F.col("highest").alias("d"), F.col("later_c").alias("next_c"), F.col("later_d").alias("next_d"),
                                    (F.col("highest") - F.col("top") + 1).alias("n_arcs"), none.alias("top"), none.alias("bottom"), F.col("top").alias("exits"), none.alias("up"))
    between = hanging.filter(F.col("has_after") & ~F.col("has_sibling")).select(
        F.col("up").alias("c"), F.col("at").alias("d"), F.col("after.conv").alias("next_c"), inner(-1).alias("next_d"),
        (F.col("at") - F.col("after.at")).alias("n_arcs"), none.alias("top"), none.alias("bottom"), (F.col("after.at") + 1).alias("exits"), none.alias("up"))
    return written(down.select(columns).unionByName(last.select(columns)).unionByName(between.select(columns)), "op12-runs")


def list_ranks(runs: DataFrame) -> DataFrame:
    """(c, d, dist): the arcs from the start of each element to the end of the tour, by pointer jumping: in each round an
    element adds what its successor has and takes over the successor's successor, so that spans double."""
    ranks = written(runs.select("c", "d", "next_c", "next_d", F.col("n_arcs").alias("dist")), "op12-ranks")
    for _ in range(max(0, runs.count() - 1).bit_length()):
        to = ranks.select(F.col("c").alias("next_c"), F.col("d").alias("next_d"), F.col("next_c").alias("then_c"), F.col("next_d").alias("then_d"), F.col("dist").alias("more"))
        jumped = (ranks.filter(F.col("next_c").isNotNull()).join(to, ["next_c", "next_d"])
                  .select("c", "d", F.col("then_c").alias("next_c"), F.col("then_d").alias("next_d"), (F.col("dist") + F.col("more")).alias("dist")))
        after = written(jumped.unionByName(ranks.filter(F.col("next_c").isNull())), "op12-ranks")
        dropped(ranks)
        ranks = after
    return ranks.select("c", "d", "dist")


def tour_arcs(runs: DataFrame, ranks: DataFrame, total: int) -> DataFrame:
    """(c, depth, enter, pos, leaf, parent, inner): every arc with its place in the tour; on enter arcs whether the node is a
    leaf, its parent's name and how many children it has on its own path."""
    placed = runs.join(ranks, ["c", "d"]).withColumn("start", F.lit(total) - F.col("dist"))
    pieces = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_arcs") - 1, F.lit(STEP).cast("long"))))
    each = pieces.withColumn("i", F.explode(F.sequence(F.col("i"), F.least(F.col("i") + STEP, F.col("n_arcs")) - 1)))
    length = F.col("bottom") - F.col("top") + 1
    enter = (F.col("d") == -1) & (F.col("i") < length)
    depth = F.when(enter, F.col("top") + F.col("i")).when(F.col("d") == -1, F.col("bottom") - (F.col("i") - length)).otherwise(F.col("d") - F.col("i"))
    each = each.select("c", depth.alias("depth"), enter.alias("enter"), (F.col("start") + F.col("i")).alias("pos"), "top", "bottom", "exits", "up")
    at_bottom = F.col("depth") == F.col("bottom")
    return each.select("c", "depth", "enter", "pos", (F.col("enter") & at_bottom & (F.col("exits") <= F.col("bottom"))).cast("long").alias("leaf"),
                       F.when(F.col("enter"), F.when(F.col("depth") > F.col("top"), F.col("c")).otherwise(F.col("up"))).alias("parent"),
                       F.when(F.col("enter"), (~at_bottom).cast("long")).alias("inner"))


def subtree_sums(nodes: DataFrame, arcs: DataFrame, total: int) -> DataFrame:
    """(conv, depth, parent, inner, n_leaves, saved_tokens): what the prefix sums over the arcs gain from a node's enter to its exit arc."""
    spark = nodes.sparkSession
    saved = nodes.select(F.col("conv").alias("c"), "depth", F.lit(True).alias("enter"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    size = -(-total // (4 * n_partitions(spark)))
    held = written(arcs.join(saved, ["c", "depth", "enter"], "left").fillna(0, ["saved"])
                   .withColumn("block", F.floor(F.col("pos") / size)), "op12-arcs")
    leaves = saves = 0
    before = []
    for r in held.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).orderBy("block").collect():  # 4 rows a partition
        before.append((r["block"], leaves, saves))
        leaves, saves = leaves + r["leaf"], saves + r["saved"]
    offsets = spark.createDataFrame(before, "block long, leaves_before long, saved_before long")
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = held.withColumns({"leaves": F.sum("leaf").over(w), "saves": F.sum("saved").over(w)}).join(F.broadcast(offsets), "block")
    gain = lambda s, own, before: F.sum(F.when(F.col("enter"), F.col(own) - F.col(s) - F.col(before)).otherwise(F.col(s) + F.col(before)))
    return sums.groupBy(F.col("c").alias("conv"), "depth").agg(
        F.max("parent").alias("parent"), F.max("inner").alias("inner"),
        gain("leaves", "leaf", "leaves_before").alias("n_leaves"), gain("saves", "saved", "saved_before").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, those of equal turn by the hash of role and text. A null role or text is empty;
    rows with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty
    table gives no rows. Other columns play no part, whatever their names."""
    nodes = trie_nodes(conversations.select("conv_id", "turn", "role", "text"))
    paths = trie_paths(nodes)
    runs = tour_runs(paths)
    ranks = list_ranks(runs)
    total = 2 * nodes.count()
    sums = subtree_sums(nodes, tour_arcs(runs, ranks, total), max(total, 1))
    hanging = paths.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("hanging"))
    return (nodes.select("conv", "depth", "n_convs", "ends_sha256").join(sums, ["conv", "depth"]).join(hanging, ["conv", "depth"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                    (F.col("inner") + F.coalesce("hanging", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"))
