"""Prefix trie of conversations by Z-fast tries.

A conversation is a path of prefix hashes, one a turn.  A task inserts its conversations in batches
into a compacted trie: a node stands for the edge above it, (depth of its parent, own depth], and
hangs in a table under its handle, the prefix at the two-fattest depth of that range (the depth
divisible by the largest power of two).  The node at which a conversation leaves the trie is found by a fat binary
search: look up the prefix at the two-fattest depth of the open range, go on below the depth
that a hit proves, above it after a miss.  An insert splits an edge at most and adds a leaf.

When a batch is full, sums over the members of every node go up the trie and its edges are
expanded to one row a prefix.  Equal prefixes of all batches meet by their hash in a grouped sum, to
which a prefix comes once a batch, however many conversations share it.

Whatever a node needs from its subtree is such a sum over members.  Of n conversations through a
node at depth d, ``total - before(d)`` characters each lie in the subtree; the characters of its
different nodes are summed by giving every node to its smallest member, which owns a suffix of
its own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from crosspanel.llm.frames import map_batches, staged
from crosspanel.llm.shards import CRC_TABLE, sql_crc32

HASH_BYTES = 16
ROOT = bytes(HASH_BYTES)
HEAD_TURNS = 5
BLOCK = 100
#: Prefixes in a batch, after which it is expanded.
BATCH = 200_000
#: Ids of a node that are joined to one string before they are hashed.
ID_RANGE = 4096


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & -1 << (low ^ high).bit_length() - 1


class ZFastTrie:
    """Compacted trie of prefix-hash paths with sums over the members of its nodes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.depth, self.parent, self.path = [0], [-1], [()]
        self.sums, self.least = [[0] * width], [None]
        self.handles: dict[bytes, int] = {}
        self.below: dict[bytes, int] = {}  # node by the first prefix of its edge

    def locate(self, path: Sequence[bytes]) -> tuple[int, int]:
        """The node on whose edge ``path`` ends or leaves the trie, and the depth there."""
        node, low, high = 0, 0, len(path)
        while low < high:
            at = two_fattest(low, high)
            hit = self.handles.get(path[at - 1])
            if hit is None:
                high = at - 1
                continue
            depth = self.depth[hit]
            if depth <= len(path) and path[depth - 1] == self.path[hit][depth - 1]:
                node, low = hit, depth
                high = max(high, low)
            else:
                return hit, self._shared(path, hit, at)
        if low < len(path):
            child = self.below.get(path[low])
            if child is not None:
                return child, self._shared(path, child, low + 1)
        return node, low

    def _shared(self, path: Sequence[bytes], node: int, known: int) -> int:
        """How deep ``path`` follows the edge of ``node``, at least to depth ``known``."""
        low, high = known, min(len(path), self.depth[node])
        while low < high:
            middle = (low + high + 1) // 2
            if path[middle - 1] == self.path[node][middle - 1]:
                low = middle
            else:
                high = middle - 1
        return low

    def _hang(self, node: int) -> None:
        top, path = self.depth[self.parent[node]], self.path[node]
        self.handles[path[two_fattest(top, self.depth[node]) - 1]] = node
        self.below[path[top]] = node

    def _add(self, parent: int, depth: int, path: Sequence[bytes]) -> int:
        self.depth.append(depth)
        self.parent.append(parent)
        self.path.append(path)
        self.sums.append([0] * self.width)
        self.least.append(None)
        self._hang(len(self.depth) - 1)
        return len(self.depth) - 1

    def insert(self, path: Sequence[bytes], member: int, values: Sequence[int]) -> None:
        node, depth = self.locate(path)
        if depth < self.depth[node]:  # inside an edge: its upper part becomes a node
            top = self.depth[self.parent[node]]
            del self.handles[self.path[node][two_fattest(top, self.depth[node]) - 1]]
            upper = self._add(self.parent[node], depth, self.path[node])
            self.parent[node] = upper
            self._hang(node)
            node = upper
        if depth < len(path):
            node = self._add(node, len(path), path)
        self.sums[node] = [a + b for a, b in zip(self.sums[node], values, strict=True)]
        self.least[node] = member if self.least[node] is None else min(self.least[node], member)

    def expanded(self) -> Iterator[tuple[int, Sequence[bytes], int, int, list[int]]]:
        """Edges with what their nodes sum up: depth above, path, depth, smallest member, sums."""
        for node in sorted(range(len(self.depth)), key=lambda x: -self.depth[x]):
            parent, least = self.parent[node], self.least[node]
            if least is None:
                continue  # the root of an empty trie
            if parent >= 0:
                self.sums[parent] = [a + b for a, b in zip(self.sums[parent], self.sums[node], strict=True)]
                self.least[parent] = least if self.least[parent] is None else min(self.least[parent], least)
            yield self.depth[parent] if parent >= 0 else -1, self.path[node], self.depth[node], least, self.sums[node]


def prefix_sums(paths: DataFrame, values: Sequence[str], batch: int = BATCH) -> DataFrame:
    """Per prefix: node, parent (null for the root), depth, least member and the sums of ``values``.

    ``paths`` has conv_id, prefixes and the value columns.
    """
    schema = StructType([StructField("node", BinaryType()), StructField("parent", BinaryType()), StructField("depth", LongType()), StructField("least", LongType())] + [StructField(v, LongType()) for v in values])

    def expand(trie: ZFastTrie) -> pa.RecordBatch:
        node, parent, depth, count, rows = [], [], [], [], []
        for top, path, bottom, least, sums in trie.expanded():
            first = max(top, 0)
            node += path[first:bottom] if bottom else [ROOT]
            parent += [ROOT if first == 0 else path[first - 1], *path[first : bottom - 1]] if bottom else [None]
            depth += range(first + 1, bottom + 1) if bottom else [0]
            count.append(max(bottom - first, 1))
            rows.append((least, *sums))
        wide = np.repeat(np.array(rows, dtype=np.int64).reshape(len(rows), 1 + len(values)), count, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int64()), *[pa.array(wide[:, k]) for k in range(wide.shape[1])]], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = ZFastTrie(len(values)), 0
        for part in batches:
            columns = [part.column(c).to_pylist() for c in ("conv_id", "prefixes", *values)]
            for member, path, *numbers in zip(*columns, strict=True):
                trie.insert(path, member, numbers)
                size += len(path) + 1
                if size >= batch:
                    yield expand(trie)
                    trie, size = ZFastTrie(len(values)), 0
        if size:
            yield expand(trie)

    parts = map_batches(paths.select("conv_id", "prefixes", *values), run, schema)
    return parts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("least").alias("least"), *[F.sum(v).alias(v) for v in values])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) where conversation c begins with the first turns of conversation c - c % 100.

    Turns are hashes of role and text with the text's code points, ordered by turn (nulls
    first), ties by role and then by the hash.  A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), hashed.alias("hash"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    own = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: F.struct(t["hash"].alias("hash"), t["chars"].alias("chars"))).alias("own"))
    own = staged(own, "trie-turns")
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("own", 1, HEAD_TURNS).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    both = own.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "block", "left")
    rest = F.slice("own", taken + 1, F.greatest(F.size("own") - taken, F.lit(0)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast(own.schema["own"].dataType)), F.lit(1), taken), rest).alias("turns"))


def _by_turn(a, b):
    less = F.lit(False)
    for field in ("hash", "role", "turn"):
        x, y = a[field], b[field]
        less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False)) | (x.eqNullSafe(y) & less)
    same = a["turn"].eqNullSafe(b["turn"]) & (a["role"] == b["role"]) & (a["hash"] == b["hash"])
    return F.when(same, 0).when(less, -1).otherwise(1)


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, prefixes, upto, total): a hash for each prefix, the characters of each from depth 0, and all."""
    schema = StructType([StructField("conv_id", LongType()), StructField("prefixes", ArrayType(BinaryType())), StructField("upto", ArrayType(LongType())), StructField("total", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            prefixes = []
            upto = [list(accumulate(chars, initial=0)) for chars in part.column("chars").to_pylist()]
            for hashes in part.column("hashes").to_pylist():
                at, path = ROOT, []
                for h in hashes:
                    at = hashlib.blake2b(at + h, digest_size=HASH_BYTES).digest()
                    path.append(at)
                prefixes.append(path)
            columns = [pa.array(prefixes, pa.list_(pa.binary())), pa.array(upto, pa.list_(pa.int64())), pa.array([u[-1] for u in upto], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), *columns], schema.names)

    return map_batches(turns.select("conv_id", F.col("turns.hash").alias("hashes"), F.col("turns.chars").alias("chars")), run, schema)


def _ends_digest(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: digest of their ids in order.

    A digest reads its ids one after the other; they come to it as strings of up to ``ID_RANGE`` ids.
    """
    end = F.when(F.size("prefixes") > 0, F.element_at("prefixes", -1)).otherwise(F.lit(bytearray(ROOT)))
    ends = paths.select("conv_id", end.alias("node"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy("node", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(joined.alias("ids"))
    schema = StructType([StructField("node", BinaryType()), StructField("ends_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for part in batches:
            out = []
            for node, ids in zip(part.column("node").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if node == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], schema.names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()], pa.string())], schema.names)

    ordered = ranges.repartition("node").sortWithinPartitions("node", "range").select("node", "ids")
    return map_batches(ordered, run, schema)


def prefix_trie(turns: DataFrame, batch: int = BATCH) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), turns being (hash, chars): all columns of the query.

    A conversation without turns is a member of the root.  No conversations, no nodes.  Ids are unique.
    """
    paths = staged(paths_of(turns), "trie-paths")
    with_n = paths.withColumn("n", F.lit(1).cast("long"))
    nodes = staged(prefix_sums(with_n, ["n", "total"], batch), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-shape")

    # A member owns the nodes it is the smallest one of: those from some depth on.
    owners = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.min("depth").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = paths.join(owners, "conv_id").withColumn("own", F.col("total") - F.element_at("upto", F.greatest("owned", F.lit(1)).cast("int")))
    owned = staged(owned, "trie-owners")
    below = prefix_sums(owned, ["own", "leaf"], batch).select("node", F.col("own").alias("sum_own"), "leaf")

    # What the smallest member of a node tells about it: the characters before its last turn.
    first = F.greatest("owned", F.lit(1)).cast("int")
    told = owned.select("conv_id", "own", "total", "owned", F.posexplode(F.slice("upto", first, F.size("upto") - first)).alias("k", "before"))
    told = told.select("conv_id", "own", "total", "owned", (F.col("k") + F.greatest("owned", F.lit(1))).cast("long").alias("depth"), "before")
    root = owned.where("owned = 0").select("conv_id", "own", "total", "owned", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"))
    told = told.unionByName(root).withColumnRenamed("conv_id", "least").withColumnRenamed("total", "own_total")
    shaped = nodes.join(told, ["least", "depth"]).join(below, "node")
    # Only the first node that a member owns has another's node above it.
    upper = nodes.select(F.col("node").alias("parent"), F.col("least").alias("upper"))
    first = shaped.where("depth = owned AND depth > 0").join(upper, "parent").select("node", "upper")
    out = shaped.join(first, "node", "left").join(_ends_digest(paths), "node", "left")
    inside = F.col("total") - F.col("n") * F.col("before")
    distinct = F.col("sum_own") - F.col("own") + F.col("own_total") - F.col("before")
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("upper", "least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaf").alias("n_leaves"),
        (inside - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE = f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, list(struct_pack(h := coalesce(role, '') || chr(1) || length(coalesce(text, '')) || chr(1) || coalesce(text, ''), n := length(coalesce(text, '')))
  ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
b AS (SELECT o.conv_id, o.ts, p.ts AS head, ({sql_crc32("o.conv_id::VARCHAR")} % {HEAD_TURNS + 1})::INT AS h FROM o LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % {BLOCK}, crc_table),
r AS (SELECT conv_id, list_concat(coalesce(head, [])[1:h], ts[h + 1:]) AS ts FROM b),
x AS (SELECT conv_id, len(ts) AS size, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
y AS (SELECT conv_id, size, depth, sha256(array_to_string(list_transform(ts[1:depth], lambda t: t.h), chr(2))) AS k, sha256(array_to_string(list_transform(ts[1:depth - 1], lambda t: t.h), chr(2))) AS up, CASE depth WHEN 0 THEN 0 ELSE ts[depth].n END AS chars FROM x),
n AS (SELECT depth, k, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM y GROUP BY 1, 2),
c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
a AS (SELECT DISTINCT v.depth AS vd, v.k AS vk, u.depth, u.k FROM y v JOIN y u ON u.conv_id = v.conv_id AND u.depth <= v.depth),
s AS (SELECT a.depth, a.k, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved FROM a JOIN l v ON v.depth = vd AND v.k = vk GROUP BY 1, 2)
SELECT l.conv_id, l.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, l.ends_sha256
FROM l JOIN s USING (depth, k) LEFT JOIN n p ON p.depth = l.depth - 1 AND p.k = l.up
"""
