"""A trie of conversation prefixes.

Every distinct sequence of first turns is a node. Equal conversations are merged
first, so each sequence enters once, with a weight. What is left is dealt out by a
hash of the first turn, and each bucket's subtries are built in ``applyInPandas``:
a dictionary of pointers (node, turn) -> node, summed in postorder by a loop, as
children always have higher numbers than their parents.

A first turn with more rows than a task should hold is not built there. The turns
that all its conversations share are rows of a table (a chain of nodes), the rest is
dealt out again by the next turn, and so on; sums come back up by grouping. Each such
step divides a group, so chains of any length take one step.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Table

#: Places in a row that one task orders: 2**this.
STRIDE = 10
#: Conversation ids that meet in one list: 2**this.
IDS = 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [x.split()[0] for x in NODE.split(", ")]
ROOT = b""


def running_sum(df: DataFrame, key: str, place: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``key``, in the order that ``order`` gives and ``place``
    (a long, null first) follows. A key's rows are summed by strides of places, so no key meets in one task."""
    dealt = df.withColumn("_stride", F.coalesce(F.shiftright(place, STRIDE), F.lit(NULL_ID)))
    inside = Window.partitionBy(key, "_stride").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = dealt.groupBy(key, "_stride").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    own = dealt.withColumn(name, F.sum(value).over(inside))
    return own.join(strides.drop("_sum"), [key, "_stride"]).withColumn(name, F.col(name) + F.col("_before")).drop("_stride", "_before")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of every row with a conv_id, without the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return running_sum(rows, "conv_id", "turn", order, F.lit(1), "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "chars")


def rebuilt(conversations: DataFrame, *, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) and (conv_id, len): conversation c with its first h turns replaced by
    those of c - c % block, h = crc32(c in decimal) % most."""
    own = Table(ordered_turns(conversations)).df
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    bases = sizes.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(bases, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = Table(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))).df
    heads = own.where((F.col("conv_id") % block == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    grafted = plan.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    tails = own.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    return Table(grafted.unionAll(tails)).df, plan.select("conv_id", "len")


def _digested(batches):
    """Lists of ids in order -> one row a class: smallest id, size, digest of the ids."""
    kinds = [("conv_id", pa.int64()), ("len", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]
    key = first = sha = None
    n = 0

    def row(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*found, strict=True)) or [[]] * 4, kinds, strict=True)], names=[k for k, _ in kinds])

    for batch in batches:
        done = []
        for *this, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if this != key:
                if key is not None:
                    done.append((first, key[0], n, sha.hexdigest()))
                key, first, sha, n = this, ids[0], hashlib.sha256(), 0
            sha.update((("," if n else "") + ",".join(map(str, ids))).encode())
            n += len(ids)
        yield row(done)
    if key is not None:
        yield row([(first, key[0], n, sha.hexdigest())])


def merged(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, len, n, ends): equal conversations once, by their smallest id; ends is the SHA-256 of their ids.

    A conversation's key is the exclusive or of 128-bit hashes of (depth, turn), so it is combined before the
    shuffle. Ids meet in lists of at most 2**16, and a class's lists are digested one after another, in order.
    """
    keys = turns.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64(F.lit(1), "depth", "digest")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "digest", "depth")).alias("b")
    )
    own = lengths.join(keys, "conv_id", "left").select("conv_id", "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    lists = own.groupBy("len", "a", "b", F.shiftright("conv_id", IDS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = lists.repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "part").select("len", "a", "b", "ids")
    return lists.mapInArrow(_digested, "conv_id long, len long, n long, ends string")


def subtries(rows):
    """The nodes of the subtries whose rows these are, tops marked by ``up``; a frame in, a frame out."""
    import pandas as pd

    rows = rows.sort_values(["g", "conv_id", "depth"], kind="stable")
    pointers: dict[tuple, int] = {}
    conv, depth, parent, n, chars, children, ends, up, outer = ([] for _ in range(9))
    node = -1
    columns = (rows[c].tolist() for c in ("g", "start", "conv_id", "depth", "n", "digest", "chars", "ends", "up", "up_conv"))
    for g, start, c, d, weight, digest, size, end, above, above_conv in zip(*columns, strict=True):
        top = d == start
        key = (-1, g) if top else (node, digest)
        found = pointers.get(key)
        if found is None:
            found = pointers[key] = len(conv)
            conv.append(c)
            depth.append(d)
            parent.append(-1 if top else node)
            n.append(0)
            chars.append(size)
            children.append(0)
            ends.append(None)
            up.append(above if top else None)
            outer.append(above_conv if top else conv[node])
            if not top:
                children[node] += 1
        node = found
        n[node] += weight
        if isinstance(end, str):
            ends[node] = end
    leaves = [int(not k) for k in children]
    saved = [(m - 1) * size for m, size in zip(n, chars, strict=True)]
    for i in range(len(conv) - 1, -1, -1):  # postorder: a node's children were all summed before it
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    return pd.DataFrame({"up": up, **dict(zip(NAMES, (conv, depth, outer, n, children, leaves, saved, ends), strict=True))})


def _oversized(active: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the groups in ``big``: (their shared turns, the groups, the rows below, dealt by their next turn)."""
    rows = Table(active.join(big.select("g"), "g")).df
    per = rows.groupBy("g", "depth").agg(
        F.count("*").alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("chars").alias("chars"), F.max("ends").alias("ends")
    )
    per = Table(per).df
    groups = rows.where("depth = start").groupBy("g", "start", "up", "up_conv").agg(F.min("conv_id").alias("conv"), F.sum("n").alias("n"), F.count("*").alias("members"))
    shared = (F.col("c") == F.col("members")) & (F.col("lo") == F.col("hi"))
    last = per.join(groups.select("g", "members"), "g").groupBy("g").agg(F.coalesce(F.min(F.when(~shared, F.col("depth"))) - 1, F.max("depth")).alias("last"))
    groups = Table(groups.join(last, "g").drop("members")).df
    chain = per.join(groups, "g").where("depth <= last").select("g", "start", "last", "up", "up_conv", "conv", "n", "depth", "chars", "ends")
    chain = running_sum(chain, "g", "depth", [F.col("depth")], F.col("chars"), "upto")
    rest = rows.drop("up", "up_conv", "start").join(groups.select("g", "last", "conv"), "g").where("depth > last")
    following = rest.where("depth = last + 1").select("conv_id", F.unhex(F.md5(F.concat("g", "digest"))).alias("next"))
    below = rest.join(following, "conv_id").select(
        F.col("next").alias("g"), (F.col("last") + 1).alias("start"), F.col("g").alias("up"), F.col("conv").alias("up_conv"), "conv_id", "len", "n", "ends", "depth", "digest", "chars"
    )
    return Table(chain).df, groups, Table(below).df


def _closed(chain: DataFrame, tops: DataFrame) -> DataFrame:
    """The chains' nodes, with the sums of what hangs below them; ``tops`` are nodes with ``up``."""
    kids = tops.groupBy("up").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "g")
    whole = chain.groupBy("g").agg(F.sum("chars").alias("all_chars"))
    nodes = chain.join(whole, "g").join(kids, "g", "left")
    kids_of = F.coalesce("kids", F.lit(0))
    return nodes.select(
        F.when(F.col("depth") == F.col("start"), F.col("up")).alias("up"),
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("start"), F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("last"), F.lit(1)).otherwise(kids_of).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("all_chars") - F.col("upto") + F.col("chars")) + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def prefix_nodes(turns: DataFrame, lengths: DataFrame, *, max_rows: int = 2000) -> DataFrame:
    """One row a node of the trie over ``turns`` (conv_id, depth from 1, digest, chars); ``lengths``
    (conv_id, len) has every conversation, those without turns too.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A first turn, or a longer shared beginning, with more than ``max_rows`` rows is
    dealt out again by its next turn. No conversations: no rows.
    """
    spark = turns.sparkSession
    total = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not total["n"]:
        return spark.createDataFrame([], NODE)
    classes = Table(merged(turns, lengths)).df
    first = turns.where("depth = 1").select("conv_id", F.col("digest").alias("g"))
    own = turns.join(classes.where("len > 0").join(first, "conv_id"), "conv_id")
    own = own.select("g", F.lit(1).cast("long").alias("start"), F.lit(ROOT).alias("up"), F.lit(total["least"]).cast("long").alias("up_conv"), "conv_id", "len", "n",
        F.when(F.col("depth") == F.col("len"), F.col("ends")).alias("ends"), "depth", "digest", "chars")
    active, levels = Table(own).df, []
    while True:
        sizes = Table(active.groupBy("g").agg(F.count("*").alias("rows"))).df
        n_rows = sizes.agg(F.sum("rows")).first()[0] or 0
        big = sizes.where(F.col("rows") > max_rows)
        some_big = not big.isEmpty()
        small = active.join(big.select("g"), "g", "left_anti") if some_big else active
        n_buckets = max(-(-n_rows // max_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
        bucket = F.pmod(F.xxhash64("g"), F.lit(n_buckets))
        built = Table(small.groupBy(bucket.alias("bucket")).applyInPandas(subtries, f"up binary, {NODE}")).df
        if not some_big:
            levels.append((built, None))
            break
        chain, _, below = _oversized(active, big)
        levels.append((built, chain))
        active = below
    found, tops = None, None
    for built, chain in reversed(levels):
        nodes = built if chain is None else built.unionAll(Table(_closed(chain, tops)).df)
        tops = nodes.where("up is not null")
        found = nodes if found is None else found.unionAll(nodes)
    sums = tops.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    ends = classes.where("len = 0").select("ends").first()
    root = (total["least"], 0, None, total["n"], sums["kids"], sums["leaves"] or 1, sums["saved"] or 0, ends["ends"] if ends else None)
    return found.select(*NAMES).unionAll(spark.createDataFrame([root], NODE)).fillna(EMPTY, ["ends_sha256"])


def rebuilt_trie(conversations: DataFrame, *, block: int = 100, most: int = 6, max_rows: int = 2000) -> DataFrame:
    """The trie of the rebuilt conversations, see ``rebuilt`` and ``prefix_nodes``.

    Turns stand in the order of turn (null first), then role, then a hash of role and
    text; repeated rows are turns of their own. A null role or text is empty. Rows with
    a null conv_id belong to no conversation. For negative ids c % block has the sign of
    c. Other columns are not read. Texts are read once and never shuffled. No rows: no rows.
    """
    return prefix_nodes(*rebuilt(conversations, block=block, most=most), max_rows=max_rows)
