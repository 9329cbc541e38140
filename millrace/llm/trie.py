"""Prefix trie of conversations with subtree totals by depth-band rollup.

A node is a distinct sequence of the first d turns (role and text) of a conversation; the root is the empty sequence. Sequences are
known by running sums: every turn adds a hash of its depth, role and text, in four sums of 31 bits, so two sequences of one depth are
taken for the same only if 124 bits agree. Sums run over ordered buckets (``ordered.running_sum``), so a conversation with a third of
all turns is cut like any other table.

Subtree totals rise in bands of ``HEIGHT`` depths. Inside a band a node is exploded to its ancestors there, at most ``HEIGHT`` of them,
which are known from pieces of conversations of one band each. The band roots then form a trie of their own, ``HEIGHT`` times less deep, whose
totals are found the same way; completed totals of band roots are at last exploded to the ancestors in the band above. So there are
log(depth) / log(HEIGHT) levels of a few shuffles each, and no row is copied more than ``HEIGHT`` times a level. All totals are summed
before they are shuffled, so the root and other wide nodes are one row per task there.

The numbers of the conversations that end at a node are joined in ascending order and hashed. Ids are first joined in pieces of
``IDS`` consecutive numbers; the pieces of a node then stream through one SHA-256, which holds one piece at a time.

Turns are ordered by turn (null first), then role and text. Null roles and texts count as empty, so rows that differ in that
alone are one turn's ties. Repeated rows are turns of their own. A null conversation id is a conversation like the others, whose number
is written "null" and comes last; it takes no turns from others. An empty table gives no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace import ordered
from millrace.session import cut_lineage

HEIGHT = 8
#: Consecutive ids that are joined before they are hashed.
IDS = 4096
#: A rebuilt conversation starts with up to ``SHARED - 1`` turns of the first of its ``FAMILY`` conversations.
FAMILY, SHARED = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()
BITS = (1 << 31) - 1
KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, a, b, size): the turns of every conversation, numbered from 1, as two hashes of role and text and the text's length;
    texts go no further."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    slim = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").isNotNull().cast("int").alias("known"), F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(F.lit(1), role_, F.lit(0), text_).alias("a"), F.xxhash64(F.lit(2), role_, F.lit(0), text_).alias("b"),
        F.length(text_).cast("long").alias("size"), F.substring(role_, 1, 64).alias("r1"), F.substring(text_, 1, 64).alias("t1"))
    # Ties of one turn: role, then text, by their first characters and a hash of the rest.
    slim = cut_lineage(slim)
    placed = ordered.with_position(slim, ["known", "turn", "r1", "t1", "a"], ["conv"], name="depth")
    return placed.select("conv", (F.col("depth") + 1).alias("depth"), "a", "b", "size")


def shared_starts(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(conv, depth, a, b, size, total): every conversation c rebuilt from the first h turns of conversation c - c % family, then its own turns after
    its first h, where h = crc32(c) % shared. A conversation left without turns is one row of depth null. ``total`` is its number of turns."""
    h = F.when(F.col("conv").isNull(), F.lit(0)).otherwise(F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")) % shared).cast("int")
    sizes = cut_lineage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family}))
    # What others may take of a conversation: its first turns, a short list.
    heads = turns.where((F.col("depth") < shared) & (F.col("conv") % family == 0)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "a", "b", "size"))).alias("head"))
    info = sizes.join(heads, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)"))
    info = cut_lineage(info.select("conv", "n", "h", F.size("head").cast("long").alias("k"), "head").withColumn(
        "total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    taken = info.select("conv", "total", F.explode("head").alias("t")).select("conv", "t.depth", "t.a", "t.b", "t.size", "total")
    short = info.select(F.col("conv").alias("c"), "h", "k", "total")
    own = turns.join(short, F.col("conv").eqNullSafe(F.col("c"))).where("depth > h").select(
        "conv", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "size", "total")
    bare = info.where("total = 0").select("conv", F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"),
                                          F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("size"), "total")
    return taken.union(own).union(bare)


def _key(sums: list[Column]) -> list[Column]:
    low = [s.bitwiseAND(F.lit(BITS)) for s in sums]
    return [F.shiftleft(low[0], 31).bitwiseOR(low[1]), F.shiftleft(low[2], 31).bitwiseOR(low[3])]


def paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, size, total): the node of every turn and its parent; the root stands once for each conversation, at depth 0.

    ``rows`` has (conv, depth, a, b, size, total), as ``shared_starts`` gives it.
    """
    rows = rows.withColumn("root", F.explode(F.when(F.col("depth").isNull(), F.array(F.lit(True))).when(
        F.col("depth") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    depth = F.when(F.col("root"), F.lit(0)).otherwise(F.col("depth")).cast("long")
    term = lambda i: F.when(F.col("root"), F.lit(0)).otherwise(F.xxhash64(F.lit(i), F.col("depth"), "a", "b").bitwiseAND(F.lit(BITS)))
    slim = cut_lineage(rows.select("conv", depth.alias("depth"), F.when(F.col("root"), 0).otherwise(F.col("size")).cast("long").alias("size"), "total",
                                   *[term(i).cast("long").alias(f"x{i}") for i in range(4)]))
    run = ordered.running_sum(slim, ["depth"], {f"s{i}": F.col(f"x{i}") for i in range(4)}, ["conv"])
    here = _key([F.col(f"s{i}") for i in range(4)])
    above = _key([F.col(f"s{i}") - F.col(f"x{i}") for i in range(4)])
    return run.select("conv", "depth", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"), "size", "total")


def _ancestors(rows: DataFrame, step: int, width: int) -> DataFrame:
    """(depth, k1, k2, up): for every node below the root whose depth ``step`` divides, its ancestors of such depths down from the last band root
    above it; bands are ``width`` deep. They are read off pieces of conversations that hold one band and the root of the next."""
    band = F.floor(F.col("depth") / width)
    both = F.when((F.col("depth") > 0) & (F.col("depth") % width == 0), F.array(band, band - 1)).otherwise(F.array(band))
    pieces = rows.where(F.col("depth") % step == 0).select("conv", *KEY, F.explode(both).alias("band")).groupBy("conv", "band").agg(
        F.array_sort(F.collect_list(F.struct(*KEY))).alias("path"))
    each = pieces.select("band", F.explode(F.transform("path", lambda x, i: F.struct(x.alias("own"), F.slice("path", F.lit(1), i).alias("up")))).alias("e"))
    below = each.where(F.col("e.own.depth") > F.col("band") * width).select("e.own.*", "e.up")
    return below.groupBy(*KEY).agg(F.first("up").alias("up"))


def rolled_up(rows: DataFrame, values: DataFrame, names: list[str], height: int = HEIGHT, deepest: int | None = None, step: int = 1) -> DataFrame:
    """(depth, k1, k2, names...): the sums of ``names`` over each node's subtree, itself included.

    ``rows`` is ``paths``; ``values`` has one row per node whose depth ``step`` divides.
    """
    if deepest is None:
        deepest = values.agg(F.max("depth")).first()[0] or 0
    width = step * height
    sums = [F.sum(n).alias(n) for n in names]
    up = cut_lineage(_ancestors(rows, step, width))
    # Up to the ancestors in the same band; a band root starts its own.
    lifted = values.where(F.col("depth") % width != 0).join(up, KEY).select(F.explode("up").alias("u"), *names).select("u.*", *names)
    inside = cut_lineage(values.select(*KEY, *names).union(lifted).groupBy(*KEY).agg(*sums))
    if deepest < width:
        return inside
    roots = inside.where(F.col("depth") % width == 0)
    whole = cut_lineage(rolled_up(rows, roots, names, height, deepest, width))
    # Completed totals of band roots go to the ancestors in the band above, but for that band's root, which has its own.
    down = whole.where("depth > 0").join(up, KEY).select(F.explode("up").alias("u"), *names).where(F.col("u.depth") % width != 0).select("u.*", *names)
    rest = inside.where(F.col("depth") % width != 0).union(down).groupBy(*KEY).agg(*sums)
    return rest.union(whole.select(rest.columns))


def ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_ends, ends_sha256): the conversations that end at a node, as the hash of their numbers in ascending order."""
    last = rows.where("depth = total").select(*KEY, "conv", F.floor(F.col("conv") / IDS).alias("piece"))
    pieces = last.groupBy(*KEY, "piece").agg(F.array_sort(F.collect_list("conv")).alias("ids"), F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("piece").isNull(), F.lit("null")).otherwise(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))
    pieces = pieces.select(*KEY, F.col("piece").isNull().alias("late"), "piece", said.alias("said"), "n")
    streamed = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "late", "piece")

    def run(batches):
        names = [*KEY, "n_ends", "ends_sha256"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        now, digest, n = None, None, 0
        for batch in batches:
            out = []
            for *node, said, count in zip(*[batch[c].to_pylist() for c in (*KEY, "said", "n")]):
                if node != now:
                    if now:
                        out.append((*now, n, digest.hexdigest()))
                    now, digest, n = node, hashlib.sha256(), 0
                elif n:
                    digest.update(b",")
                digest.update(said.encode())
                n += count
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*now, n, digest.hexdigest()), kinds)], names)

    return streamed.select(*KEY, "said", "n").mapInArrow(run, "depth long, k1 long, k2 long, n_ends long, ends_sha256 string")


def nodes(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every node of the trie of ``paths``: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    n_ends, ends_sha256, and its key (k1, k2)."""
    rows = cut_lineage(rows)
    found = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    found = cut_lineage(found)
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    known = cut_lineage(found.join(children, KEY, "left").fillna(0, ["n_children"]))
    own = known.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = rolled_up(rows, own, ["n_leaves", "saved_tokens"], height)
    # The root is one row, and many nodes may be its children.
    root = known.where("depth = 0").select("conv_id").first()
    parents = known.where("n_children > 0 AND depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(totals, KEY).join(ends(rows), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "k1", "k2")


def trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", height: int = HEIGHT,
    family: int = FAMILY, shared: int = SHARED,
) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations; with ``shared`` 1 every conversation is taken as it is."""
    return nodes(paths(shared_starts(turns(conversations, conv, turn, role, text), family, shared)), height)
