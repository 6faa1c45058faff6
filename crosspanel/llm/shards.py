"""Random shards by a two-pass external shuffle.

The first pass scatters whole records uniformly into buckets that fit in memory, by a seeded hash
of the record, and deals the buckets out in their final order.  The second pass shuffles every
bucket by Fisher and Yates (inside out: record i takes a random place among the first i, whose
holder moves to place i) and lays the buckets end to end.  Equal cuts of that sequence are the
shards, so their counts differ by one at most.  A task of the second pass holds buckets that
follow one another and writes them to the files of their shards, so a text moves once.  Every
draw is a hash of the seed, hence the order depends neither on partitions nor on retried tasks.

Records that are equal in id and text are numbered first, so that many copies of one record
scatter over the buckets like different ones.  A bucket's number of records is about
``bucket_rows`` and its text about ``bucket_bytes``, whichever needs more buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.llm.frames import drop_staged, shuffle_cleanup, staged
from crosspanel.session import ensure_checkpoint_dir

SHARDS = 24
SEED = 11
BUCKET_ROWS = 2048
BUCKET_BYTES = 32 << 20
#: Text that a task of the second pass sorts, in whole buckets.
PIECE_BYTES = 32 << 20
#: Buckets are laid out in this many rows of buckets, so that no task adds up all of them.
LANES = 256
LAW = "rows"
#: Codec of files that hold texts.
CODEC = "zstd"


def digest_number(parts: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def fisher_yates(n: Column, seed: Column) -> Column:
    """A random order of 1 to n as an array."""
    draws = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), (F.pmod(digest_number(F.concat_ws(":", seed, i)), i) + 1).cast("int").alias("j")))

    def swap(order: Column, x: Column) -> Column:
        i, j = x["i"], x["j"]
        moved = F.concat(F.slice(order, F.lit(1), j - 1), F.array(i), F.slice(order, j + 1, i - 1 - j), F.array(F.element_at(order, j)))
        return F.when(j == i, F.concat(order, F.array(i))).otherwise(moved)

    return F.aggregate(draws, F.array().cast("array<int>"), swap)


def text_checks(text: Column) -> list[Column]:
    """Size (UTF-8 bytes plus 8) and CRC-32 of a text; null counts as empty."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    return [size.cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")]


def _numbered(records: DataFrame) -> DataFrame:
    """Records with ``copy``, counting from 0 those of equal id and text.

    Copies are counted within the partition that wrote them and shifted by the copies of the
    partitions before it, so no task sees all copies of a record.  Only keys travel for that.
    Records with copies are staged anew and the given ones deleted, since a join with many
    copies moves the texts, and its files would stay beside those of the scatter.
    """
    same = ["key_id", "key_text"]
    keys = records.select("uid", *same)
    repeated = staged(keys.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1").select(*same), "shard-repeats")
    if repeated.isEmpty():
        return records.withColumn("copy", F.lit(0).cast("long"))
    many = keys.join(repeated, same, "left_semi").withColumn("part", F.shiftright("uid", 33))
    local = [*same, "part"]
    counts = many.groupBy(*local).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*local, before.alias("before"))
    nth = F.row_number().over(Window.partitionBy(*local).orderBy("uid")) - 1
    many = many.withColumn("nth", nth).join(counts, local).select("uid", (F.col("before") + F.col("nth")).cast("long").alias("later"))
    later = staged(many.where("later > 0"), "shard-copies")
    numbered = records.join(later, "uid", "left").withColumn("copy", F.coalesce("later", F.lit(0).cast("long"))).drop("uid", "later", "size")
    numbered = staged(numbered, "shard-numbered", CODEC)
    drop_staged(records)
    return numbered


def shuffle_records(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record, all columns, with its shard and slot.

    Adds size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (from 0, without
    gaps) and grown_shard (null: counts, not ids, decide the shard).  A null text has no bytes.
    Null ids are a value like any other.  Records equal in id and text are interchangeable: which
    of them takes which of their slots isn't defined.  Columns called like an output are
    replaced.  An empty table gives no rows; with fewer records than shards the last stay empty.
    The partitions follow one another in shard and slot order.
    """
    spark = docs.sparkSession
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    records = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("record"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key_id"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("key_text"),
        text_checks(F.col("text"))[0],
        F.monotonically_increasing_id().alias("uid"),
    )
    records = staged(records, "shard-records", CODEC)
    total = records.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    buckets = max(-(-total.n // bucket_rows), -(-(total.bytes or 0) // bucket_bytes), 1)
    pieces = min(buckets, max(spark.sparkContext.defaultParallelism, -(-(total.bytes or 0) // PIECE_BYTES)))

    hashed = _numbered(records).select("record", F.md5(F.concat_ws(":", F.lit(str(seed)), "key_id", "key_text", "copy")).alias("hash"))
    scattered = hashed.withColumn("bucket", F.pmod(F.conv(F.substring("hash", 1, 15), 16, 10).cast("long"), F.lit(buckets)))

    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("lane", F.pmod("bucket", F.lit(LANES)))
    lanes = counts.groupBy("lane").agg(F.sum("n").alias("lane_n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = lanes.select("lane", before("lane_n", Window.orderBy("lane")).alias("lane_at"))
    starts = counts.withColumn("at", before("n", Window.partitionBy("lane").orderBy("bucket"))).join(lanes, "lane")
    starts = staged(starts.select("bucket", F.col("n").cast("int").alias("n"), (F.col("at") + F.col("lane_at")).alias("first")), "shard-starts")

    bucket = Window.partitionBy("first").orderBy("hash")
    ranked = scattered.join(starts, "bucket").repartitionByRange(pieces, "first").withColumn("i", F.row_number().over(bucket))
    drawn = ranked.withColumn("drawn", F.when(F.col("i") == 1, fisher_yates(F.col("n"), F.concat_ws(":", F.lit(str(seed)), F.col("bucket")))))
    order = F.first("drawn", ignorenulls=True).over(bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    least, larger = divmod(total.n, shards)
    edge = larger * (least + 1)
    place = F.col("first") + F.array_position("order", F.col("i")) - 1
    placed = drawn.withColumn("order", order).select("record", place.alias("place")).withColumn("low", F.col("place") < edge)
    part = F.when(F.col("low"), F.floor(F.col("place") / (least + 1))).otherwise(larger + F.floor((F.col("place") - edge) / max(least, 1)))
    slot = F.when(F.col("low"), F.col("place") % (least + 1)).otherwise((F.col("place") - edge) % max(least, 1))
    return placed.select(
        "record.*", *text_checks(F.col("record.text")), F.lit(LAW).alias("law"), part.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(shuffled: DataFrame, path: str, laid_out: bool = False) -> None:
    """Write the records in shard and slot order as Parquet, one folder a shard.

    ``laid_out``: the partitions follow one another already, as those of ``shuffle_records`` do,
    so the records needn't move once more.
    """
    ranged = shuffled if laid_out else shuffled.repartitionByRange("shard", "slot")
    with shuffle_cleanup(shuffled.sparkSession):
        ranged.sortWithinPartitions("shard", "slot").write.mode("errorifexists").option("compression", CODEC).partitionBy("shard").parquet(path)


def build_shards(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the shards (below the checkpoint folder unless named) and read them back.

    A row a record: its place, and size and checksum of the text that its shard holds.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/shards/{uuid.uuid4().hex}"
    shuffled = shuffle_records(docs)
    write_shards(shuffled, path, laid_out=True)
    drop_staged(shuffled)
    back = spark.read.schema(shuffled.schema).parquet(path)
    return back.select("doc_id", *text_checks(F.col("text")), "law", "shard", "slot", "grown_shard")


#: CRC-32 in SQL: the table of the polynomial, and the checksum of a string.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"


def sql_crc32(value: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLE = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32, coalesce(md5(text), '') AS h FROM documents, crc_table),
t AS (SELECT count(*) AS n, greatest(ceil(count(*) / {BUCKET_ROWS}), ceil(sum(size) / {BUCKET_BYTES}), 1)::BIGINT AS buckets FROM d),
k AS (SELECT doc_id, size, text_crc32, md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), h, row_number() OVER (PARTITION BY doc_id, h) - 1)) AS hash FROM d),
b AS (SELECT ('0x' || hash[1:15])::BIGINT % buckets AS bucket, list(struct_pack(hash, doc_id, size, text_crc32) ORDER BY hash) AS records FROM k, t GROUP BY 1),
s AS (SELECT *, sum(len(records)) OVER (ORDER BY bucket % {LANES}, bucket) - len(records) AS first FROM b),
f AS (SELECT first, records, list_reduce(list_prepend([]::BIGINT[], list_transform(range(1, len(records) + 1), lambda i: [('0x' || md5(concat_ws(':', '{SEED}', bucket, i))[1:15])::BIGINT % i + 1])),
  lambda o, x: CASE WHEN x[1] > len(o) THEN list_append(o, x[1]) ELSE list_append(list_concat(list_append(o[1:x[1] - 1], len(o) + 1), o[x[1] + 1:]), o[x[1]]) END) AS places FROM s),
p AS (SELECT first, records, unnest(places) AS i, generate_subscripts(places, 1) - 1 AS nth FROM f),
g AS (SELECT first + nth AS place, records[i] AS r, t.n // {SHARDS} AS q, t.n % {SHARDS} AS m FROM p, t)
SELECT r.doc_id AS doc_id, r.size::BIGINT AS size, r.text_crc32::BIGINT AS text_crc32, '{LAW}' AS law,
  (CASE WHEN place < m * (q + 1) THEN place // (q + 1) ELSE m + (place - m * (q + 1)) // greatest(q, 1) END)::INT AS shard,
  (CASE WHEN place < m * (q + 1) THEN place % (q + 1) ELSE (place - m * (q + 1)) % greatest(q, 1) END)::BIGINT AS slot, NULL::INT AS grown_shard
FROM g
"""
