"""Quality rules with thresholds learned from the data, in DataFrame functions only.

Fixed base rules come first.  For the documents that pass them, four ratios are summarised
per language and source by a mergeable quantile sketch: integer values fall into buckets of
at most 1/32 relative width, and a bucket keeps its count.  Sketches merge by adding counts,
so a source with few documents falls back on its language and that on all documents.  A
document is dropped when a ratio lies outside the fences of its group, quartile plus or minus
``FENCE`` times the quartile distance and a least spread.  Counts are exact and additive, so
the verdict doesn't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from crosspanel.llm.frames import staged

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
FENCE = 3
MIN_ROWS = 100

#: Ratio, its least spread and whether too small a value counts as well.
RATIOS = {"symbols": (200, False), "word_length": (100, True), "dup_lines": (5000, False), "repeats": (2500, False)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value to a name, so the body may use it often and it is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    window = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), window)

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
            starts = F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(placed, count))

    return F.when(n < 4, 0).otherwise(let(windows, covered))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text.

    A null text has no words; an empty line or one of white space is no duplicate.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"))
    per_row = let(
        words_of(F.col("t")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        per_row.alias("w"),
        per_line.alias("l"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The ratios in whole ten-thousandths (word length in hundredths of a character)."""
    share = lambda a, b: F.floor(F.lit(a) * F.col(b[0]) / F.greatest(F.col(b[1]), F.lit(1))).cast("long")
    return {
        "symbols": share(10000, ("n_symbols", "word_chars")),
        "word_length": share(100, ("word_chars", "n_words")),
        "dup_lines": share(10000, ("n_dup_lines", "n_lines")),
        "repeats": share(10000, ("n_repeat_words", "n_words")),
    }


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket: exact below 64, then the six leading bits."""
    shift = (F.length(F.bin(v)) - 6).cast("int")
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) of the rows that pass the base rules."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()]))
    passed = rows.where(~base_failed()).select("lang", "source", stacked.alias("s"))
    return passed.groupBy("lang", "source", "s.ratio", "s.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """Merge sketches to the groups ``by``; rows, first and third quartile of each ratio."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "ratio")
    counted = merged.select("*", F.sum("n").over(part.orderBy("bucket")).alias("upto"), F.sum("n").over(part).alias("rows"))
    least = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    return counted.groupBy(*by, "ratio").agg(F.struct(F.max("rows").alias("rows"), least(1).alias("q1"), least(3).alias("q3")).alias(name))


def fences(sketch: DataFrame, fence: int = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per language and source, the lowest and highest value of each ratio that is kept."""
    own, lang, every = (quartiles(sketch, by, n) for by, n in ((["lang", "source"], "own"), (["lang"], "of_lang"), ([], "of_all")))
    lang = lang.withColumnsRenamed({"lang": "l_lang", "ratio": "l_ratio"})
    every = every.withColumnRenamed("ratio", "a_ratio")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio"))).join(every, F.col("ratio") == F.col("a_ratio"))
    chosen = F.when(F.col("own.rows") >= min_rows, F.col("own")).when(F.col("of_lang.rows") >= min_rows, F.col("of_lang")).otherwise(F.col("of_all"))
    rows = joined.select("lang", "source", "ratio", chosen.alias("q")).select("*", (F.col("q.q3") - F.col("q.q1")).alias("d"))
    columns = []
    for k, (spread, both) in RATIOS.items():
        wide = F.lit(fence) * F.col("d") + spread
        columns.append(F.max(F.when(F.col("ratio") == k, F.col("q.q3") + wide)).alias(f"{k}_most"))
        if both:
            columns.append(F.max(F.when(F.col("ratio") == k, F.col("q.q1") - wide)).alias(f"{k}_least"))
    return rows.groupBy("lang", "source").agg(*columns)


def judge_quality(docs: DataFrame, fence: int = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and the ratios.

    Null languages and sources form groups of their own.  Repeated rows count as often as
    they occur.  An empty table gives no rows.
    """
    rows = staged(measured(docs.select("doc_id", "text", "lang", "source")), "quality")
    limits = staged(fences(sketches(rows), fence, min_rows), "fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    values = ratios()
    inside = F.lit(True)
    for k, (_, both) in RATIOS.items():
        inside = inside & (values[k] <= F.col(f"{k}_most"))
        if both:
            inside = inside & (values[k] >= F.col(f"{k}_least"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
        *[v.alias(f"{k}_ratio") for k, v in values.items()],
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c FROM p),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10000 * n_symbols // greatest(word_chars, 1) AS symbols_ratio, 100 * word_chars // greatest(n_words, 1) AS word_length_ratio,
    10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines_ratio, 10000 * n_repeat_words // greatest(n_words, 1) AS repeats_ratio
  FROM m),
s AS (
  SELECT lang, source, ratio, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::INT) << (length(bin(v)) - 6)::INT END AS b
  FROM (UNPIVOT (SELECT * FROM f WHERE NOT base_failed) ON symbols_ratio, word_length_ratio, dup_lines_ratio, repeats_ratio INTO NAME ratio VALUE v)),
levels AS (
  SELECT 1 AS level, lang, source, ratio, b FROM s UNION ALL SELECT 2, lang, NULL, ratio, b FROM s UNION ALL SELECT 3, NULL, NULL, ratio, b FROM s),
q AS (
  SELECT level, lang, source, ratio, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3
  FROM levels GROUP BY level, lang, source, ratio),
fence AS (
  SELECT o.lang, o.source, o.ratio,
    CASE WHEN o.n >= 100 THEN o.q1 WHEN l.n >= 100 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN o.n >= 100 THEN o.q3 WHEN l.n >= 100 THEN l.q3 ELSE a.q3 END AS q3,
    CASE o.ratio WHEN 'symbols_ratio' THEN 200 WHEN 'word_length_ratio' THEN 100 WHEN 'dup_lines_ratio' THEN 5000 ELSE 2500 END AS spread
  FROM q o JOIN q l ON l.level = 2 AND l.ratio = o.ratio AND l.lang IS NOT DISTINCT FROM o.lang JOIN q a ON a.level = 3 AND a.ratio = o.ratio
  WHERE o.level = 1),
bad AS (
  SELECT DISTINCT u.r FROM (UNPIVOT (SELECT * FROM f) ON symbols_ratio, word_length_ratio, dup_lines_ratio, repeats_ratio INTO NAME ratio VALUE v) u
  JOIN fence e ON e.ratio = u.ratio AND e.lang IS NOT DISTINCT FROM u.lang AND e.source IS NOT DISTINCT FROM u.source
  WHERE v > q3 + 3 * (q3 - q1) + spread OR (u.ratio = 'word_length_ratio' AND v < q1 - 3 * (q3 - q1) - spread))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.r IS NULL AS kept, symbols_ratio, word_length_ratio, dup_lines_ratio, repeats_ratio
FROM f LEFT JOIN bad USING (r)
"""
