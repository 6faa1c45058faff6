"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Texts with equal sets are one node.
For two nodes of a and b shingles to reach similarity 3/4 their symmetric difference may
have ``(a + b) / 7`` members at most.  Each size band deals the shingles into blocks and keeps
the XOR (the parity) of the hashes in a block: a shingle that only one side has changes one
block, so linked nodes differ in that many blocks at most.  By pigeonhole two linked nodes
share one of their first ``d + 1`` blocks in any common order, and blocks join on (band,
place, parity).  The order puts blocks with a rare shingle first, using frequencies of the
whole corpus in a table of fixed size, so that shared passages rarely make candidates.

Candidates are not expanded into pairs: a node is first compared with the smallest
node of its blocks, its hub.  A block whose shingles are frequent is split into parts to find it.  A hub is read once for some hundred texts compared with it.  Only nodes that meet in a block and are still in different
components are compared with each other, after bounds on their symmetric difference (from
what both add to and lack of their hub, then from the Hamming distance of bit sketches) have
ruled out what they can.  Every comparison is decided on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from crosspanel.llm.components import components
from crosspanel.llm.frames import map_batches, staged
from crosspanel.llm.textbytes import IS_SPACE, LOWER, column_bytes, mix64, text_slices

SHINGLE = 5
LOAD = 2.5
FREQUENCY_BITS = 17
#: Texts compared with one hub in a task.
SHARE = 256
SKETCH_PER_SHINGLE = 4

_U = np.uint64
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_STEP = _U(0x5851F42D4C957F2D)


def shingle_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text of a slice; empty without words."""
    data, starts, ends = column_bytes(part.column("text"))
    if not len(starts):
        return []
    a = int(starts[0])
    raw = data[a : int(max(ends.max(), a))]
    starts, ends = starts - a, ends - a
    if not len(raw):
        return [np.zeros(0, dtype=_U)] * len(starts)
    inside = ~IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = starts[(starts < ends) & (starts < len(raw))]
    begins[first] = inside[first]
    word_at = np.flatnonzero(begins)
    if not len(word_at):
        return [np.zeros(0, dtype=_U)] * len(starts)
    place = np.arange(len(raw)) - word_at[np.maximum(np.cumsum(begins) - 1, 0)]
    power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(place[inside].max()), _STEP, dtype=_U)]))
    value = np.where(inside, _BYTE[LOWER[raw]] * power[np.where(inside, place, 0)], _U(0))
    words = mix64(np.add.reduceat(value, word_at) + np.add.reduceat(inside.astype(_U), word_at) * _PLACE[4])
    joined = np.zeros(max(len(words) - SHINGLE + 1, 0), dtype=_U)
    for k in range(SHINGLE):
        joined += words[k : k + len(joined)] * _PLACE[k]
    joined = mix64(joined)
    lo, hi = np.searchsorted(word_at, starts), np.searchsorted(word_at, ends)
    out = []
    for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
        n = j - i
        if n >= SHINGLE:
            out.append(np.unique(joined[i : j - SHINGLE + 1]))
        elif n > 0:
            whole = sum((words[i + k : i + k + 1] * _PLACE[k] for k in range(n)), np.zeros(1, dtype=_U))
            out.append(mix64(whole + _PLACE[n]))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def band_of(n: int) -> int:
    return n.bit_length() - 1


def least_shared(n: int) -> int:
    """How many keys a node of ``n`` shingles shares at least with a linked node of no fewer.

    Each key beyond the ``d + 1`` of the pigeonhole adds one to what linked nodes share, so
    a few more keys rule out nodes that meet in a block or two by chance.
    """
    return 1 + n // 64


def block_keys(shingles: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks by which a node meets every node it may link with, and their levels."""
    n = len(shingles)
    own = band_of(n)
    made, height = [], []
    for band in (own, own + 1) if 4 * n >= 3 * (2 << own) else (own,):
        top = 2 << band  # sizes of the band are below this
        differ = (n + min(4 * n // 3, top - 1)) // 7
        blocks = max(int(np.ceil(top / LOAD)), 2 * top // 7 + least_shared(top))
        salted = mix64(shingles ^ mix64(np.full(1, band + 1, dtype=_U)))
        place = (salted >> _U(20)) % _U(blocks)
        order = np.argsort(place, kind="stable")
        place, salted = place[order], salted[order]
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parity = np.bitwise_xor.reduceat(salted, head)
        size = np.diff(np.concatenate([head, [n]]))
        level = np.minimum.reduceat(levels[(shingles[order] & _U((1 << FREQUENCY_BITS) - 1)).astype(np.int64)], head)
        key = mix64(parity ^ mix64(place[head] * _PLACE[2] + _U(band)))
        want = differ + least_shared(n)
        best = np.lexsort((key, -size, level))[:want]
        key, level = key[best], level[best]
        if len(key) < want:  # too few filled blocks: empty ones agree as well
            free = np.setdiff1d(np.arange(blocks, dtype=_U), place[head])[: want - len(key)]
            key = np.concatenate([key, mix64(mix64(free * _PLACE[3]) + _U(band))])
            level = np.concatenate([level, np.zeros(len(free), dtype=level.dtype)])
        made.append(key)
        height.append(level)
    return np.concatenate(made).view(np.int64), np.concatenate(height)


def bit_sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of shingles at each of ``bits`` places, packed."""
    place = (mix64(shingles) >> _U(11)) % _U(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketch_bits(n: int) -> int:
    """Sketch size of both bands that a pair with a smaller side of ``n`` may lie in."""
    return max(64, SKETCH_PER_SHINGLE << (band_of(max(n, 1)) + 1))


_SUMMARY = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), ("h", LongType()), ("n", LongType()), ("sig1", LongType()), ("sig2", LongType()), ("bucket", IntegerType()), ("freq", LongType()))])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    freq = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    names = _SUMMARY.names
    for part in text_slices(batches, "text"):
        sets = shingle_sets(part)
        for s in sets:
            np.add.at(freq, (s & _U(len(freq) - 1)).astype(np.int64), 1)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        one = np.array([np.add.reduce(mix64(s ^ _PLACE[0])) for s in sets], dtype=_U).view(np.int64)
        two = np.array([np.bitwise_xor.reduce(mix64(s ^ _PLACE[3])) if len(s) else 0 for s in sets], dtype=_U).view(np.int64)
        nothing = pa.nulls(len(n), pa.int32())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n), pa.array(one), pa.array(two), nothing, pa.nulls(len(n), pa.int64())], names)
    used = np.flatnonzero(freq)
    empty = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(used.astype(np.int32)), pa.array(freq[used])], names)


def _levels(summary: DataFrame) -> np.ndarray:
    """How far above the usual each bucket of the frequency table is, in powers of two."""
    rows = summary.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("freq").alias("freq")).toPandas()
    freq = np.zeros(1 << FREQUENCY_BITS)
    freq[rows["bucket"].to_numpy(dtype=np.int64)] = rows["freq"].to_numpy(dtype=np.float64)
    usual = np.median(freq) + 1
    return np.maximum(np.floor(np.log2(np.maximum(freq, 1) / (2 * usual))), 0).astype(np.uint8)


class _Nodes:
    """Where the text of a node stands: rows (doc_id, h, text) and nodes (node, doc_id, h)."""

    def __init__(self, rows: DataFrame, places: DataFrame) -> None:
        self.rows, self.places = rows, places

    def with_text(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (with a column node) plus the node's text.

        Texts always meet ids in a merge join: the ids grow with the corpus, so sending them to
        every task would only work for a small one.
        """
        return self.rows.join(wanted.join(self.places, "node").hint("merge"), ["doc_id", "h"])


def _compared(pairs: DataFrame, nodes: _Nodes, levels: np.ndarray) -> DataFrame:
    """Per pair (x, y): linked, size of y, how many shingles y lacks of x and adds to it.

    ``added`` lists the rarest of the latter, a quarter of y and one: a node linked with y has all
    of y but a quarter, so it has one of them unless it adds nothing that y adds.  It is null if y
    adds more than half of itself.  All y of an x stream past its set, ``SHARE`` or so in a task.
    """
    schema = StructType([StructField("x", LongType()), StructField("y", LongType()), StructField("linked", BooleanType())] + [StructField(n, LongType()) for n in ("n", "lost", "more")] + [StructField("added", ArrayType(LongType()))])
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    shares = pairs.groupBy("x").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    beside = pairs.join(shares, "x").select("x", F.pmod(F.xxhash64("y"), F.col("shares")).alias("share"), "y", F.col("y").alias("node"))
    itself = shares.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("y"), F.col("x").alias("node"))
    stream = nodes.with_text(beside.unionByName(itself)).repartition("x", "share").sortWithinPartitions("x", "share", "y").select("x", "y", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(0, dtype=_U)
        for part in text_slices(batches, "text"):
            rows = []
            for x, y, t in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), shingle_sets(part), strict=True):
                if y is None:
                    s = t
                    continue
                new = np.setdiff1d(t, s, assume_unique=True).view(np.int64)
                both = len(t) - len(new)
                linked = bool(both) and 100 * both >= 75 * (len(s) + len(new))
                few = new
                if len(new) > len(t) // 4 + 1:
                    few = new[np.lexsort((new, levels[new & (len(levels) - 1)]))[: len(t) // 4 + 1]]
                rows.append((x, y, linked, len(t), len(s) - both, len(new), few if 2 * len(new) <= len(t) else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], schema.names)

    return map_batches(stream, compare, schema)


def _sketches(texts: DataFrame) -> DataFrame:
    """(ref, n, small, large): bit sketches for partners of the own band and of the next."""
    schema = StructType([StructField("ref", LongType()), StructField("n", LongType()), StructField("sketches", ArrayType(BinaryType()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part)
            rows = [[bit_sketch(s, sketch_bits(len(s) >> 1)).tobytes(), bit_sketch(s, sketch_bits(len(s))).tobytes()] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.list_(pa.binary()))], schema.names)

    return map_batches(texts, make, schema)


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketch distance allow the similarity."""
    side = lambda k: sketches.select(F.col("ref").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketches").alias(f"s_{k}"))
    sized = pairs.join(side("x"), "x").join(side("y"), "y").where("4 * n_x >= 3 * n_y AND 4 * n_y >= 3 * n_x")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for n, m, s, t in zip(part.column("n_x").to_pylist(), part.column("n_y").to_pylist(), part.column("s_x").to_pylist(), part.column("s_y").to_pylist(), strict=True):
                common = next(((u, v) for u in s for v in t if len(u) == len(v)), None)
                distance = 0 if common is None else int.from_bytes(common[0], "big").__xor__(int.from_bytes(common[1], "big")).bit_count()
                keep.append(7 * distance <= n + m)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("x").filter(keep), part.column("y").filter(keep)], ["x", "y"])

    return map_batches(sized.select("x", "y", "n_x", "n_y", "s_x", "s_y"), near, StructType([StructField("x", LongType()), StructField("y", LongType())]))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and the number of copies of its set.

    Null and empty texts have no shingles and link with nothing.  Rows that repeat an id belong
    to one component, whatever their texts link with; rows without an id belong to none (null).
    An empty table gives no rows.
    """
    members = text_components(docs)
    by_id = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component").alias("x"), F.max("component").alias("hi")).where("x <> hi")
    by_id = staged(by_id.drop("hi"), "shingle-ids")
    if not by_id.isEmpty():
        wider = components(members.join(by_id, "doc_id").select("x", F.col("component").alias("y")).distinct())
        wider = wider.select(F.col("node").alias("component"), F.col("component").alias("wider"))
        members = members.join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component"))
    # A component goes by a node, which is its smallest id unless that node goes by a hash.
    if not members.where("doc_id IS NOT NULL AND hashed").isEmpty():
        smallest = staged(members.groupBy("component").agg(F.min("doc_id").alias("smallest")), "shingle-smallest")
        members = members.join(smallest, "component", "left").withColumn("component", F.col("smallest"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "copies")


def surplus_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, keep, times): which rows, by id and hash of the text, stand for their texts' component.

    One row of each component is kept, the smallest; ``times`` is how often the row occurs.  Texts
    that only share an id are no copies.  Rows without words or without an id aren't listed.
    """
    members = text_components(docs).where("n > 0 AND doc_id IS NOT NULL")
    kept = members.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("kept"))
    rows = members.groupBy("doc_id", "h", "component").agg(F.count("*").alias("times"))
    return rows.join(kept, "component").select("doc_id", "h", (F.struct("doc_id", "h") == F.col("kept")).alias("keep"), "times")


def text_components(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, component, copies, hashed) per row: components of texts alone, ids aside.

    A component goes by its smallest node, and a node by its smallest id, or by a hash where one id is the
    smallest of several sets (``hashed``).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    summary = staged(map_batches(rows, _summaries, _SUMMARY), "shingle-summary")
    levels = _levels(summary)
    sized = summary.where("bucket IS NULL").drop("bucket", "freq")
    same = ["sig1", "sig2", "n"]
    first_row = F.min(F.struct("doc_id", "h"))
    classes = sized.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(first_row.alias("at"), F.count("*").alias("copies"))
    classes = staged(classes.select(*same, "at.doc_id", "at.h", "copies"), "shingle-classes")
    several = staged(classes.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id", F.lit(True).alias("several")), "shingle-several")
    if several.isEmpty():
        classes = classes.withColumns({"node": F.col("doc_id"), "hashed": F.lit(False)})
    else:
        classes = classes.join(several, "doc_id", "left").withColumn("hashed", F.coalesce("several", F.lit(False)))
        classes = classes.withColumn("node", F.when(F.col("hashed"), F.xxhash64("doc_id", *same)).otherwise(F.col("doc_id")))
    members = sized.join(classes.select(*same, "node", "copies", "hashed"), same, "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")
    members = staged(members.select("doc_id", "h", "n", node, F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("hashed", F.lit(False)).alias("hashed")), "shingle-members")
    nodes = _Nodes(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), staged(classes.select("node", "doc_id", "h"), "shingle-nodes"))
    met = _met_blocks(nodes, levels)

    # A node's hub is the one it meets most often; chance meetings are left to the second step.
    votes = met.where("ref <> hub").groupBy("ref", "hub").agg(F.count("*").alias("votes"), F.min("n").alias("n"))
    first = votes.where(4 * F.col("votes") >= 1 + F.floor(F.col("n") / 64)).groupBy(F.col("ref").alias("y")).agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("x"))
    first = staged(first.select("x", "y"), "shingle-pairs")
    compared = staged(_compared(first, nodes, levels), "shingle-compared")
    links = compared.where("linked").select("x", "y").distinct()
    label = components(links)

    # What still meets across components.
    placed = met.select("key", "ref", "n").join(label.withColumnRenamed("node", "ref"), "ref", "left").select("key", "ref", "n", F.coalesce("component", "ref").alias("c"))
    spread = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = staged(placed.join(spread, "key", "left_semi").distinct(), "shingle-open")
    rest = _open_pairs(open_, compared)
    rest = staged(rest.join(first, ["x", "y"], "left_anti"), "shingle-rest")
    ends = rest.select(F.col("x").alias("node")).unionByName(rest.select(F.col("y").alias("node"))).distinct()
    near = staged(_plausible(rest, staged(_sketches(nodes.with_text(ends)), "shingle-sketches")), "shingle-near")
    more = staged(_compared(near, nodes, levels).where("linked").select("x", "y").distinct(), "shingle-links")
    label = components(links.unionByName(more))
    return members.join(label, "node", "left").select("doc_id", "h", "n", F.coalesce("component", "node").alias("component"), "copies", "hashed")


def _met_blocks(nodes: _Nodes, levels: np.ndarray) -> DataFrame:
    """(key, ref, n, hub) of nodes that share a block with another one.

    A block of level k is dealt into 2^k parts by a hash of the node.  Its hub is the smallest of
    the parts' smallest nodes and goes back to the parts in a join, so no task holds a frequent block.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part)
            none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
            keys = [block_keys(s, levels) if len(s) else none for s in sets]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in keys])]).astype(np.int32))
            own = mix64(part.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            parts = [(o & ((_U(1) << v.astype(_U)) - _U(1))).astype(np.int32) + 1 - (v == 0) for o, (_, v) in zip(own, keys, strict=True)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, x0]))) for x, x0 in (([k for k, _ in keys], none[0]), (parts, np.zeros(0, dtype=np.int32)))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), *lists], ["doc_id", "h", "n", "keys", "parts"])

    schema = StructType([StructField(n, LongType()) for n in ("doc_id", "h", "n")] + [StructField("keys", ArrayType(LongType())), StructField("parts", ArrayType(IntegerType()))])
    keyed = map_batches(nodes.rows, emit, schema).join(nodes.places.hint("merge"), ["doc_id", "h"])
    keyed = keyed.select(F.col("node").alias("ref"), "n", F.explode(F.arrays_zip("keys", "parts")).alias("e")).select("ref", "n", F.col("e.keys").alias("key"), F.col("e.parts").alias("part"))
    block = Window.partitionBy("key", "part")
    local = keyed.select("key", "part", "ref", "n", F.min("ref").over(block).alias("hub"), F.max("ref").over(block).alias("last"))
    local = staged(local.where("hub <> last OR part > 0"), "shingle-blocks")
    whole = local.where("part > 0 AND ref = hub").groupBy("key").agg(F.min("hub").alias("hub"), F.max("last").alias("last")).where("hub <> last")
    split = local.where("part > 0").select("key", "ref", "n").join(staged(whole.select("key", "hub"), "shingle-hubs"), "key")
    return staged(local.where("part = 0").select("key", "ref", "n", "hub").unionByName(split.select("key", "ref", "n", "hub")), "shingle-met")


def _open_pairs(open_: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes of a block, in different components, that may link.

    Linked nodes share at least ``least_shared`` blocks of the smaller one.  Two nodes of one
    hub differ from it by what they add and what they lack.  If they add nothing in common,
    their symmetric difference is at least the sum of what they add plus the difference of how
    much they lack, which rules out nearly all strays of a group of copies by three numbers.
    Pairs that add something in common meet in a join on hub and shingle.
    """
    told = compared.where("added IS NOT NULL")
    facts = told.select(F.col("y").alias("ref"), F.col("x").alias("hub"), "more", "lost", "added").dropDuplicates(["ref"])
    known = staged(open_.select("ref", "n", "c").distinct().join(facts.drop("added"), "ref", "left").withColumn("hub", F.coalesce("hub", "ref")), "shingle-facts")

    left = open_.select("key", "ref", "n").join(known.drop("n"), "ref")
    right = left.select(*[F.col(k).alias(k if k == "key" else f"o_{k}") for k in left.columns])
    total = F.col("n") + F.col("o_n")
    bound = F.col("more") + F.col("o_more") + F.abs(F.col("lost") - F.col("o_lost"))
    far = F.coalesce((F.col("hub") == F.col("o_hub")) & (7 * bound > total), F.lit(False))
    sizes = (4 * F.col("n") >= 3 * F.col("o_n")) & (4 * F.col("o_n") >= 3 * F.col("n"))
    apart = (F.col("ref") < F.col("o_ref")) & (F.col("c") != F.col("o_c")) & sizes
    met = left.join(right, "key").where(apart & ~far).groupBy(F.col("ref").alias("x"), F.col("o_ref").alias("y"))
    met = met.agg(F.count("*").alias("shared"), F.min(F.least("n", "o_n")).alias("n")).where(F.col("shared") >= 1 + F.floor(F.col("n") / 64))

    shown = known.select("ref", "n", "c").join(facts, "ref").select("hub", F.explode("added").alias("shingle"), "ref", "c", "n")
    others = shown.select("hub", "shingle", *[F.col(k).alias(f"o_{k}") for k in ("ref", "c", "n")])
    together = shown.join(others, ["hub", "shingle"]).where(apart)
    return met.select("x", "y").unionByName(together.select(F.col("ref").alias("x"), F.col("o_ref").alias("y"))).distinct()


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i + 1 : i + 5], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x),
k AS (SELECT gs, count(*) AS copies FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id) GROUP BY gs),
kk AS (SELECT doc_id, copies FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id) JOIN k USING (gs))
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(copies, 1)::BIGINT AS copies
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id LEFT JOIN kk USING (doc_id)
"""
