"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``WINDOW - K + 1`` consecutive K-grams of words the one with the smallest hash is a
fingerprint, so two texts that share ``WINDOW`` words share a fingerprint of that span.
Fingerprints of documents and benchmark items meet in an equality join on the hash.  A hit is
extended word by word as far as a window around it can reach, which decides exactly whether
a whole window occurs.  Items with fewer words are one window: their whole word sequence is the
K-gram, looked up at every position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crosspanel.llm.frames import row_key, staged
from crosspanel.llm.quality import let

WINDOW = 10
K = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _NOT_WORD), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hash (32 bits) and position of every k-gram in one number, hash first."""
    number = lambda h: lambda i: F.call_function("shiftleft", F.pmod(F.xxhash64(*[h[i + j] for j in range(k)]), F.lit(2**32)), F.lit(31)).bitwiseOR(i.cast("long"))
    made = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(words) - k), number(h)))
    return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<bigint>"))


def winnowed(words: Column, k: int = K, window: int = WINDOW) -> Column:
    """Fingerprints (``grams`` numbers) of a text of at least ``window`` words."""
    span = window - k + 1
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*[g[i + j] for j in range(span)])))
    return F.when(F.size(words) >= window, let(grams(words, k), least)).otherwise(F.array().cast("array<bigint>"))


def _hash(number: Column) -> Column:
    return F.call_function("shiftrightunsigned", number, F.lit(31))


def _at(number: Column) -> Column:
    return number.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _context(words: Column, at: Column, k: int, window: int) -> Column:
    """What a window over the k-gram at ``at`` can reach: words before it (nearest first), its own, words after it."""
    reach = window - k
    before = F.when(at > 0, F.reverse(F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))))).otherwise(F.array().cast("array<string>"))
    return F.struct(before.alias("before"), F.slice(words, at + 1, F.lit(k)).alias("own"), F.slice(words, at + k + 1, F.lit(reach)).alias("after"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _fingerprints(k: int, window: int) -> Column:
    return winnowed(F.col("words"), k, window) if window > k else grams(F.col("words"), k)


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(key, item_id, start, end) of document spans all of whose words lie in occurring windows.

    ``docs`` has ``key`` and ``text``, ``items`` ``item_id`` and ``text``.
    """
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    worded = staged(worded, "benchmark-words")
    short = sorted(r.n for r in worded.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())
    found = None
    for own, size, sought in [(k, window, F.size("words") >= window)] + [(n, n, F.size("words") == n) for n in short]:
        prints = worded.where(sought).select("item_id", "words", F.explode(_fingerprints(own, size)).alias("g"))
        prints = staged(prints.select("item_id", _hash(F.col("g")).alias("hash"), _context(F.col("words"), _at(F.col("g")), own, size).alias("item")), "benchmark-prints")
        # First only hashes meet, so no text is copied for the many fingerprints that hit nothing.
        marks = docs.select("key", words_of(F.col("text")).alias("words")).select("key", F.explode(_fingerprints(own, size)).alias("g"))
        marks = marks.select("key", _at(F.col("g")).alias("at"), _hash(F.col("g")).alias("hash"))
        hits = marks.join(prints.select("hash").distinct(), "hash", "left_semi")
        places = staged(hits.groupBy("key").agg(F.collect_set(F.struct("at", "hash")).alias("places")), "benchmark-places")
        # Then the documents that are hit give the words around each place.  Their keys alone
        # are small enough to be sent to the texts more often than the places are.
        hit = docs.join(staged(places.select("key"), "benchmark-keys"), "key", "left_semi")
        around = hit.join(places, "key").select("key", words_of(F.col("text")).alias("words"), "places")
        around = around.select("key", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["hash"].alias("hash"), _context(F.col("words"), p["at"], own, size).alias("doc")))).alias("p"))
        pairs = around.select("key", "p.at", "p.hash", "p.doc").join(prints, "hash").where(F.col("doc.own") == F.col("item.own"))
        left, right = _agreeing(F.col("doc.before"), F.col("item.before")), _agreeing(F.col("doc.after"), F.col("item.after"))
        spans = pairs.select("key", "item_id", (F.col("at") - left).alias("start"), (F.col("at") + own + right).alias("end")).where(F.col("end") - F.col("start") >= size).distinct()
        found = spans if found is None else found.unionByName(spans)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: doc_id, text key, words, hit words, hit items and ``contaminated``.

    Null and empty texts have no words.  Items with a null id count as one item without a
    name (their words are hit, they appear in no list).  Repeated rows get equal results.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    spans = staged(window_hits(keyed.select("key", "text"), items, window, k), "benchmark-spans")
    covered = spans.select("key", "start", "end").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    covered = covered.select("key", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long").alias("n_hit"))
    named = spans.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hits = staged(covered.join(named, "key"), "benchmark-hits").withColumnRenamed("key", "hit_key")
    rows = keyed.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hits, F.col("key") == F.col("hit_key"), "left")
    return joined.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def digests(result: DataFrame) -> DataFrame:
    """The items of each document as a count and a digest of their sorted ids."""
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, ws[i + 1 : i + n] AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, n, i, ws[i + 1 : i + n] AS g FROM (SELECT r, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT DISTINCT r, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
