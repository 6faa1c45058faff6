"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered no deeper than ``WINDOW`` bytes, most significant digits first, and a
suffix leaves as soon as no other one shares its digits; what is still together at full depth
are exactly the repeated windows.  What repeats within a slice of texts is settled there and meets the
other slices as one row, so a passage of very many documents doesn't gather in a task.  The digits are spans cut by content, so that neighbouring
suffixes share them and one row stands for a whole interval of starts:

1. the core, all bytes between the first and last anchor that a window determines.  Windows
   with different cores differ, so an interval whose core occurs once is done;
2. the hull, a span between anchors (or text ends) around all windows of the interval, with the
   interval's place in it.  If both occur twice, so do all of its windows, and the interval is
   done as well.  Two intervals of a looped passage may share one hull, but not their place in it;
3. the windows themselves, for the few intervals at the borders of repeated passages.

Anchors are positions whose hash is the smallest within ``REACH`` positions.  Groups are only
counted, never gathered; spans compare by two 64-bit hashes.  Intervals without an anchor
(periodic text) go to the last digit at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from crosspanel.llm.frames import drop_staged, map_batches, row_key, staged
from crosspanel.llm.textbytes import column_bytes, mix64, text_slices

WINDOW = 400
GRAM = 16
REACH = 48
_U = np.uint64
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_SIZE = _U(0xC2B2AE3D27D4EB4F)

#: An interval of starts as one number: first start, then its length (12 bits).
LENGTH_BITS = 12
MOST = (1 << LENGTH_BITS) - 1


class SpanHash:
    """Hash of any span of a byte array from prefix sums."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=_U), np.full(n, _STEP, dtype=_U)]))
        self.total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(_BYTE[raw] * powers[:n], dtype=_U)])
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=_U), np.full(n, _BACK, dtype=_U)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(_U) * _SIZE)


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def anchors(hashes: SpanHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions with the smallest hash of their surroundings, all of it in one text."""
    n = len(hashes.total) - 1
    if n < GRAM + 2 * REACH:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n - GRAM + 1)
    h = hashes.of(at, at + GRAM)
    least = _ahead(h, REACH)
    own = h[REACH : len(h) - REACH]
    found = np.flatnonzero((own < least[: len(own)]) & (own <= least[REACH + 1 : REACH + 1 + len(own)])) + REACH
    row = np.searchsorted(starts, found, side="right") - 1
    return found[(found - REACH >= starts[row]) & (found + GRAM + REACH <= ends[row])]


def intervals(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Intervals of window starts that share a core: row, first start, length, core and hull hash, cored."""
    rows = np.flatnonzero(ends - starts >= window)
    none = np.zeros(0, dtype=np.int64)
    if not len(rows):
        return none, none, none, none, none, none.astype(bool)
    hashes = SpanHash(raw)
    marks = anchors(hashes, starts, ends)
    inner = window - GRAM - REACH
    cuts = np.concatenate([marks - REACH + 1, marks - inner])
    owner = np.searchsorted(starts, np.concatenate([marks, marks]), side="right") - 1
    inside = (cuts > starts[owner]) & (cuts <= ends[owner] - window)
    first = np.unique(np.concatenate([starts[rows], cuts[inside]]))
    row = np.searchsorted(starts, first, side="right") - 1
    limit = ends[row] - window + 1
    last = np.minimum(np.concatenate([first[1:], [limit[-1]]]), limit)
    # Long stretches without an anchor are cut to fit the encoding.
    pieces = -(-(last - first) // MOST)
    row, limit = np.repeat(row, pieces), np.repeat(last, pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + nth * MOST
    length = np.minimum(limit - first, MOST)
    f = np.searchsorted(marks, first + REACH)
    g = np.searchsorted(marks, first + inner, side="right") - 1
    cored = f <= g
    core = np.zeros(len(first), dtype=_U)
    if cored.any():
        core[cored] = hashes.of(marks[f[cored]], marks[g[cored]] + GRAM)
    padded = np.concatenate([[-1], marks, [len(raw) + GRAM]])
    lo = np.maximum(padded[np.searchsorted(marks, first, side="right")], starts[row])
    hi = np.minimum(padded[np.searchsorted(marks, first + length - 1 + window - GRAM) + 1] + GRAM, ends[row])
    # With the place of the interval in it, equal hulls are always two places of the table.
    place = ((first - lo) << LENGTH_BITS) | length
    hull = mix64(hashes.of(lo, hi) + mix64(place.astype(_U) + _U(1)))
    return row, first - starts[row], length, core.view(np.int64), hull.view(np.int64), cored


def _local(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice with starts and ends relative to them; nulls are empty."""
    data, starts, ends = column_bytes(part.column("text"))
    a = int(starts[0]) if len(starts) else 0
    # Null rows may hide bytes, so rows are laid end to end again where needed.
    raw = data[a : int(max(ends.max(initial=a), a))]
    return raw, starts - a, ends - a


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of the group of equal keys that each row is in, and which rows are the first of theirs."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    sizes, first = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
    sizes[order] = np.repeat(size, size)
    first[order[start]] = True
    return sizes, first


def _first_digits(window: int):
    names = ["k1", "k2", "core", "hull", "pos", "key", "sure", "here"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            row, first, length, core, hull, cored = intervals(*_local(part), window)
            at = pa.array(row)
            pos = (first << LENGTH_BITS) | length
            # Without a core there is nothing to compare yet: a number of its own, marked by the sign.
            alone = mix64(hull.view(_U) + first.astype(_U)).view(np.int64)
            core = np.where(cored, core, alone)
            # What is equal within the slice is settled here; one row of it meets the other slices.
            size, teller = _groups(core)
            here, one = _groups(hull, core)
            apart = mix64(alone.view(_U) + np.arange(len(row), dtype=_U)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1").take(at), part.column("k2").take(at), pa.array(core), pa.array(hull), pa.array(np.where(cored, pos, ~pos)),
                 pa.array(np.where(teller, core, apart)), pa.array(cored & (size > 1)), pa.array(np.where(one, here, 0))], names
            )

    return run


def _last_digit(window: int):
    names = ["core", "digit", "k1", "k2", "start", "known", "settled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            raw, starts, _ = _local(part)
            wanted = part.column("open").to_pylist()
            if not any(wanted):
                continue
            hashes = SpanHash(raw)
            cores, at, rows, known = [], [], [], []
            for i, spans in enumerate(wanted):
                for x in spans or ():
                    cored, pos = x["pos"] >= 0, x["pos"] if x["pos"] >= 0 else ~x["pos"]
                    begin, n = pos >> LENGTH_BITS, pos & MOST
                    cores.append(np.full(n, x["core"] if cored else 0, dtype=np.int64))
                    at.append(np.arange(begin, begin + n))
                    rows.append(np.full(n, i))
                    known.append(np.full(n, x["known"]))
            cores, at, rows, known = (np.concatenate(x) for x in (cores, at, rows, known))
            digit = hashes.of(at + starts[rows], at + starts[rows] + window).view(np.int64)
            # Windows that repeat within the slice are settled here; one of them tells the other slices.
            size, teller = _groups(digit, cores)
            k1, k2 = part.column("k1"), part.column("k2")
            r = pa.array(rows[teller])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cores[teller]), pa.array(digit[teller]), k1.take(r), k2.take(r), pa.array(at[teller]), pa.array((known | (size > 1))[teller]), pa.nulls(len(r), pa.list_(pa.int64()))], names
            )
            settled = (size > 1) & ~known
            order = np.flatnonzero(settled)[np.argsort(rows[settled], kind="stable")]
            owner, begin = np.unique(rows[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), pa.array(at[order]))
            o = pa.array(owner)
            apart = mix64((owner + 1).astype(_U) + _U(int(hashes.total[-1]))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(apart), pa.array(apart), k1.take(o), k2.take(o), pa.nulls(len(o), pa.int64()), pa.array(np.ones(len(o), dtype=bool)), lists], names)

    return run


_RANGE = StructType([StructField("start", LongType()), StructField("end", LongType())])


def _cut(window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["k1", "k2", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            raw, starts, ends = _local(part)
            spans, kept = [], []
            for a, b, closed, single in zip(starts.tolist(), ends.tolist(), part.column("closed").to_pylist(), part.column("starts").to_pylist(), strict=True):
                pos = np.array([p if p >= 0 else ~p for p in closed or ()], dtype=np.int64)
                one = np.array(single or (), dtype=np.int64)
                lo = np.concatenate([pos >> LENGTH_BITS, one])
                hi = np.concatenate([(pos >> LENGTH_BITS) + (pos & MOST) - 1, one]) + window
                edge = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()])
                kept.append(raw[a:b][~gone].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(spans, kind), pa.array(kept, pa.binary())], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges) and the digest of the rest.

    A null text is empty; texts shorter than the window keep all their bytes.  Rows that
    repeat id and text are occurrences like any other.  An empty table gives no rows.
    """
    key = row_key()
    rows = docs.select("doc_id", "text", key.getField("id").alias("k1"), key.getField("hash").alias("k2"))
    long = rows.where(F.octet_length("text") >= window).select("k1", "k2", "text")
    digits = StructType([StructField(n, BooleanType() if n == "sure" else LongType()) for n in ("k1", "k2", "core", "hull", "pos", "key", "sure", "here")])
    first = map_batches(long, _first_digits(window), digits)
    shared = first.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1 OR sure OR pos < 0").select("k1", "k2", "core", "hull", "pos", "here")
    shared = staged(shared, "repeat-cores")

    by_core, by_hull = Window.partitionBy("core"), Window.partitionBy("core", "hull")
    counted = shared.where("pos >= 0 AND here > 0").select(
        "*", F.sum("here").over(by_hull).alias("n"), F.row_number().over(by_hull.orderBy("k1", "k2", "pos")).alias("nth")
    ).withColumn("least", F.min("n").over(by_core))
    # One interval of each repeated hull also shows its windows to those that are still open.
    sorted_out = counted.select("k1", "k2", "core", "pos", (F.col("n") > 1).alias("known"), ((F.col("n") == 1) | ((F.col("nth") == 1) & (F.col("least") == 1))).alias("show"))
    # Further intervals of a hull of one slice: they repeat, and need not show it again.
    further = shared.where("pos >= 0 AND here = 0").select("k1", "k2", "core", "pos", F.lit(True).alias("known"), F.lit(False).alias("show"))
    loose = shared.where("pos < 0").select("k1", "k2", "core", "pos", F.lit(False).alias("known"), F.lit(True).alias("show"))
    every = sorted_out.unionByName(further).unionByName(loose)
    per_text = every.groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("known"), F.col("pos"))).alias("closed"),
        F.collect_set(F.when(F.col("show"), F.struct("core", "pos", "known"))).alias("open"),
    )
    texts = staged(long.join(per_text, ["k1", "k2"]), "repeat-texts")
    drop_staged(shared)

    window_rows = StructType([StructField(n, LongType()) for n in ("core", "digit", "k1", "k2", "start")] + [StructField("known", BooleanType()), StructField("settled", ArrayType(LongType()))])
    shown = map_batches(texts.select("k1", "k2", "text", "open"), _last_digit(window), window_rows)
    twice = shown.withColumn("n", F.count("*").over(Window.partitionBy("core", "digit"))).where("n > 1 AND NOT known OR settled IS NOT NULL")
    found = twice.groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"), F.flatten(F.collect_list("settled")).alias("settled"))
    singles = staged(found.select("k1", "k2", F.concat("starts", "settled").alias("starts")), "repeat-starts")

    covered = texts.select("k1", "k2", "text", "closed").join(singles, ["k1", "k2"], "left").where("size(closed) > 0 OR starts IS NOT NULL")
    cut = map_batches(covered, _cut(window), StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("spans", ArrayType(_RANGE)), StructField("kept", BinaryType())]))
    cut = cut.select("k1", "k2", "spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["k1", "k2"])
    cut = staged(cut, "repeat-spans").withColumnsRenamed({"k1": "c1", "k2": "c2", "kept_sha256": "rest_sha256"})
    whole = rows.select("doc_id", "k1", "k2", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    joined = whole.join(cut, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("spans", F.array().cast(ArrayType(_RANGE))).alias("spans"), F.coalesce("rest_sha256", "text_sha256").cast(StringType()).alias("kept_sha256")
    )


def digests(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
