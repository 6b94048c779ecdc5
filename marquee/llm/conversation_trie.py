"""Prefix trie of conversations: every distinct sequence of first turns, and what sharing it would save.

A node of depth d is a distinct sequence of d first turns (role and text); its members are the conversations that
start with it. Turns are numbered and prefixes are hashed by running sums over runs of `RUN_TURNS` turns, so that no
task needs a whole conversation. A node is known by its depth and two sums of 64-bit hashes of (place, turn), and
named by its smallest member.

Subtree totals come from parallel tree contraction. A first compress takes chains whose nodes have the same members:
they share smallest member and member count, so one grouping finds them at any length. Then rounds alternate:

  rake      every leaf hands its total to its parent and is done;
  compress  of the vertices with one child left, those that draw heads while their child does not are spliced out;
            what they held goes to the edge of the child.

A vertex that was spliced out is written down with its child, and going back through the rounds its total is that
of the child and what it held. Each round joins on vertices, which are unique on both sides; children meet their
parent in sums only. The number of rounds grows with the logarithm of the number of vertices.

Defined cases: null turns come first, equal turns are ordered by role and text, null role and text are empty; rows
without conv_id belong to no conversation; repeated rows are turns of their own; other columns are not read; an
empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, in_arrow, words_of

RUN_TURNS = 1024
KEY = ["depth", "a", "b"]


def running(order: str, *by: str):
    """All rows before this one, in `order`."""
    return W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), two hashes of the turn and its number of words, for each row with a conv_id.

    Rows are ordered over all tasks, so that a conversation may span many of them; a task's share of one
    conversation is placed by the rows of the shares before it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = turns.filter("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.cut(ordered.select(
        "conv_id", F.spark_partition_id().alias("share"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"),
        F.size(words_of(F.col("text"))).cast("long").alias("words")), "turns")
    shares = held.groupBy("conv_id", "share").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = shares.select("conv_id", "share", "first", F.coalesce(F.sum("n").over(running("share", "conv_id")), F.lit(0)).alias("start"))
    pos = F.col("at") - F.col("first") + F.col("start") + 1
    return scratch.cut(held.join(starts, ["conv_id", "share"]).select("conv_id", pos.alias("pos"), "x", "y", "words"), "numbered")


def rebuilt(turns: DataFrame, scratch: Scratch, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after giving conversations a common head.

    Conversation c takes the first h turns of conversation c - c % every in place of its own first h, with
    h = crc32(decimal c) % heads. conversations has conv_id and length, also those without a turn left.
    """
    count = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    all_ = count.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = count.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = scratch.cut(all_.join(bases, "base", "left").select(
        "conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plan")
    own = turns.join(plan, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "x", "y", "words")
    first = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = first.join(plan, "base").filter("pos <= head").select("conv_id", "pos", "x", "y", "words")
    return own.union(taken), plan.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation and each of its prefixes, the empty one included.

    depth, a, b name the prefix, up_a, up_b the one a turn shorter; words are those of the last turn, so_far
    those of all turns; ends tells whether the conversation ends there.
    """
    lane = lambda *c: F.xxhash64(*c).cast("decimal(20,0)")
    rows = turns.select(
        "conv_id", "pos", ((F.col("pos") - 1) / RUN_TURNS).cast("long").alias("run"), "words",
        lane("pos", "x", "y").alias("a"), lane(F.lit(1), "pos", "y", "x").alias("b"))
    sums = [("a", "decimal(38,0)"), ("b", "decimal(38,0)"), ("words", "long")]
    runs = rows.groupBy("conv_id", "run").agg(*[F.sum(c).cast(t).alias(f"of_{c}") for c, t in sums])
    before = runs.select("conv_id", "run", *[
        F.coalesce(F.sum(f"of_{c}").over(running("run", "conv_id")).cast(t), F.lit(0).cast(t)).alias(f"of_{c}") for c, t in sums])
    inside = W.Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    summed = rows.select("conv_id", "run", "pos", "words", *[F.col(c).alias(f"own_{c}") for c in "ab"], *[
        F.sum(c).over(inside).cast(t).alias(f"in_{c}") for c, t in sums]).join(before, ["conv_id", "run"])
    fold = lambda c: (c % F.lit(1 << 62)).cast("long")
    whole = {c: F.col(f"in_{c}") + F.col(f"of_{c}") for c in ("a", "b", "words")}
    up = lambda c: F.when(F.col("pos") > 1, fold(whole[c] - F.col(f"own_{c}"))).otherwise(0)
    some = summed.join(lengths, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), fold(whole["a"]).alias("a"), fold(whole["b"]).alias("b"), up("a").alias("up_a"), up("b").alias("up_b"),
        "words", whole["words"].alias("so_far"), (F.col("pos") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    empty = lengths.select("conv_id", *[zero.alias(c) for c in [*KEY, "up_a", "up_b", "words", "so_far"]], (F.col("length") == 0).alias("ends"))
    return scratch.cut(some.union(empty), "prefixes")


def end_hashes(members: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids of the conversations that end there, ascending and comma-joined.

    The ids of a node are sorted by Spark and pass through a task one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "ends_sha256"]
        key, state, done = None, None, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)], names=names)

        for batch in batches:
            for *at, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if at == key:
                    state.update(b",%d" % conv)
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(b"%d" % conv)
            yield rows()
            done.clear()
        if key is not None:
            done.append((*key, state.hexdigest()))
            yield rows()

    ends = members.filter("ends").select(*KEY, "conv_id")
    return in_arrow(ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id"), run, "depth long, a long, b long, ends_sha256 string")


def trie_nodes(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes with their parent's smallest member and member count, and their number of children."""
    nodes = scratch.cut(members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
        F.max("words").alias("words"), F.max("so_far").alias("so_far")), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes = scratch.cut(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    root = nodes.filter("depth = 0").select("conv_id", "n_convs").first()  # one row: no join for the many children of the root
    if root is None:
        return nodes.withColumns({c: F.lit(None).cast("long") for c in ("up_conv", "up_n")})
    above = nodes.filter("depth > 0 and n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    deep = nodes.filter("depth > 1").join(above, ["depth", "up_a", "up_b"]).select(*nodes.columns, "up_conv", "up_n")
    flat = nodes.filter("depth <= 1").withColumns({
        "up_conv": F.when(F.col("depth") == 1, F.lit(root[0]).cast("long")), "up_n": F.when(F.col("depth") == 1, F.lit(root[1]).cast("long"))})
    return scratch.cut(deep.union(flat.select(*deep.columns)), "nodes")


def contracted(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """v and the totals of its subtree, for a forest (v, parent or null, saved, leaves) of any shape.

    v and parent are of one type that can be joined and compared; saved and leaves are a vertex's own values.
    """
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("v")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("long")
    state = scratch.cut(tree.join(kids, "v", "left").select(
        "v", "parent", F.coalesce("kids", zero).alias("kids"), "saved", "leaves", zero.alias("edge_saved"), zero.alias("edge_leaves")), "state")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []  # vertices raked, and those spliced out in the same round
    while True:
        raked = state.filter("kids = 0").select("v", "saved", "leaves")
        leaf = F.col("kids") == 0
        given = state.filter("parent is not null").groupBy(F.col("parent").alias("v")).agg(
            F.coalesce(F.sum(F.when(leaf, F.col("saved") + F.col("edge_saved"))), zero).alias("more_saved"),
            F.coalesce(F.sum(F.when(leaf, F.col("leaves") + F.col("edge_leaves"))), zero).alias("more_leaves"),
            F.count(F.when(~leaf, 1)).alias("left"), F.max(F.when(~leaf, F.col("v"))).alias("child"))
        alive = scratch.cut(state.filter("kids > 0").join(given, "v").select(
            "v", "parent", F.col("left").alias("kids"), (F.col("saved") + F.col("more_saved")).alias("saved"),
            (F.col("leaves") + F.col("more_leaves")).alias("leaves"), "edge_saved", "edge_leaves", "child"), "alive")
        rounds.append((raked, None))
        if alive.isEmpty():
            break
        heads = alive.filter("kids = 1 and parent is not null").filter(F.xxhash64("v", F.lit(len(rounds))) % 2 == 0)
        picked = scratch.cut(heads.join(heads.select(F.col("v").alias("child")), "child", "left_anti"), "picked")
        out = picked.select(
            F.col("child").alias("v"), F.col("v").alias("gone"), F.col("parent").alias("gone_parent"), F.col("saved").alias("gone_saved"),
            F.col("leaves").alias("gone_leaves"), F.col("edge_saved").alias("up_saved"), F.col("edge_leaves").alias("up_leaves"))
        spliced = F.col("gone").isNotNull()
        held = lambda c: F.when(spliced, F.col(f"edge_{c}") + F.col(f"gone_{c}"))
        state = scratch.cut(alive.join(picked.select("v"), "v", "left_anti").join(out, "v", "left").select(
            "v", F.when(spliced, F.col("gone_parent")).otherwise(F.col("parent")).alias("parent"), "kids", "saved", "leaves",
            F.coalesce(held("saved") + F.col("up_saved"), "edge_saved").alias("edge_saved"),
            F.coalesce(held("leaves") + F.col("up_leaves"), "edge_leaves").alias("edge_leaves"),
            "gone", held("saved").alias("held_saved"), held("leaves").alias("held_leaves")), "state")
        if not picked.isEmpty():
            rounds[-1] = raked, state.filter("gone is not null").select("gone", F.col("v").alias("child"), "held_saved", "held_leaves")
    known = None  # totals of what left the tree in this round or later
    for raked, gone in reversed(rounds):
        if gone is not None:
            total = known.select(F.col("v").alias("child"), "saved", "leaves")
            back = scratch.cut(gone.join(total, "child").select(
                F.col("gone").alias("v"), (F.col("saved") + F.col("held_saved")).alias("saved"), (F.col("leaves") + F.col("held_leaves")).alias("leaves")), "back")
            known = known.union(back)
        known = raked if known is None else known.union(raked)
    return known


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every node of the prefix trie of conversations (turns: conv_id, pos, x, y, words; lengths: conv_id, length).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes in its
    subtree), saved_tokens (over its subtree, the words of a node's last turn for each member but one) and
    ends_sha256 (of the members that end there).
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    members = prefixes(turns, lengths, scratch)
    nodes = trie_nodes(members, scratch)
    chain = F.struct("conv_id", "n_convs")
    up = F.struct(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
    above = F.struct("depth", (F.col("so_far") - F.col("words")).alias("above"), F.when(F.col("up_conv").isNotNull(), up).alias("parent"))
    tree = scratch.cut(nodes.groupBy(chain.alias("v")).agg(
        F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.min(above).alias("top"),
        F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves")).select("v", "top.parent", "saved", "leaves", "top.above"), "chains")
    totals = contracted(tree.select("v", "parent", "saved", "leaves"), scratch)
    chains = tree.select("v", "above").join(totals, "v").select("v.conv_id", "v.n_convs", "above", "saved", F.col("leaves").alias("n_leaves"))
    over = (F.col("n_convs") - 1) * (F.col("so_far") - F.col("words") - F.col("above"))  # the chain's nodes above this one
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(chains, ["conv_id", "n_convs"]).join(end_hashes(members), KEY, "left").select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("saved") - over).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) whose heads were made common by `rebuilt`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, lengths = rebuilt(numbered_turns(conversations, scratch), scratch)
    return trie(scratch.cut(turns, "rebuilt"), lengths, scratch)
