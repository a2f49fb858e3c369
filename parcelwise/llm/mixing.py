"""Operator 9: mix sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash ranges of a source within which the border of the fractional repetition is looked for row by row.
RANGES_HEX = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """Water-filling over one row per source (`source`, `source_size`, `weight`): adds `target`.

    All sources share the total by weight; one whose share is above `max_epochs` times its size is clamped there
    and its excess goes to the others by weight, until none is above. In order of size per weight the clamped
    sources come first, so the share per weight at which a source would be served follows from running sums.
    A total of zero gives targets of zero."""
    rising = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    clamped = max_epochs * F.col("source_size") < F.col("weight") * F.col("_level")
    ranked = sizes.withColumn("_level", level).withColumn("_clamped", clamped)
    # From the first source that is not clamped on, the level only falls: the highest of them holds for all.
    held = F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(everything)
    return ranked.withColumn("target", F.when(
        F.col("_clamped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * held)).drop("_level", "_clamped")


def mix(df: DataFrame, weights: list[int], max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Repetitions of every document, so that each source's words come near its target.

    Returns `id_col`, the columns `keep`, size, source_size, target, copies (whole repetitions), part (words of the fractional one,
    fewer than size), taken (= copies * size + part), one row per input row. Sources in code-point order (null
    last, a source of its own) take `weights` in turn. With r = target / source_size, a document is repeated
    floor(r) times; the rest of the target, rounded to words, is filled by one more repetition of documents in
    the order of md5(seed:id), of which the last is a fraction. So each source takes its target but for rounding,
    and no document exceeds `max_epochs` times its size.

    A source of any size is worked off in many tasks: its sizes are first added up by ranges of the hash, and
    only the range in which the border lies is summed row by row. Empty or null texts have size 0; they are
    repeated like their neighbours in that order. Repeated rows and equal ids are rows of their own, ordered by
    size. An empty table gives an empty table; further columns are ignored."""
    kept = F.struct(F.lit(0).alias("_none"), *keep).alias("_kept")
    docs = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), kept)
    docs = docs.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")))
    docs = docs.withColumn("_range", F.substring("_hash", 1, RANGES_HEX))
    ranges = docs.groupBy("_source", "_range").agg(F.sum("size").alias("_range_size"))

    sources = ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("_range_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    wanted = targets(sources.withColumn("weight", weight), max_epochs)
    wanted = wanted.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                               .otherwise(0).cast("int"))
    wanted = wanted.withColumn("_rest", F.floor(F.col("target") + 0.5) - F.col("_whole") * F.col("source_size"))

    # Words of a source before each range; the range that holds the border is the one that crosses `_rest`.
    so_far = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_range_size").over(so_far), F.lit(0)))
    ranges = ranges.join(wanted, F.col("_source").eqNullSafe(F.col("source"))).withColumn(
        "_border", (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_range_size") >= F.col("_rest")))
    plan = ranges.select("_source", "_range", "source_size", "target", "_whole", "_rest", "_before", "_range_size", "_border")

    key = [F.col("d._source").eqNullSafe(F.col("p._source")), F.col("d._range") == F.col("p._range")]
    placed = docs.alias("d").join(plan.alias("p"), key).select(
        "d._id", "d._source", "d._range", "d.size", "d._hash", "d._kept", "p.source_size", "p.target", "_whole", "_rest", "_before", "_range_size", "_border")
    inner = placed.filter("_border")
    order = Window.partitionBy("_source", "_range").orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    outer = placed.filter("NOT _border").withColumn("_at", F.when(F.col("_before") < F.col("_rest"), 0).otherwise(F.col("_rest")))
    both = inner.unionByName(outer)
    again = F.greatest(F.least(F.col("_rest") - F.col("_at"), F.col("size")), F.lit(0))
    complete = (F.col("_at") < F.col("_rest")) & (again == F.col("size"))
    part = F.when(complete, 0).otherwise(again).cast("long")
    copies = (F.col("_whole") + complete.cast("int")).cast("int")
    return both.select(F.col("_id").alias(id_col), *[F.col("_kept")[name].alias(name) for name in keep], "size", "source_size", "target", copies.alias("copies"), part.alias("part"),
                       (copies * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[int], max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: rows of `docs` (doc_id, text, source, n_chars and others), each as often as it is repeated. Of a fraction the
    first words are taken, joined by blanks; its n_chars is that of what is left."""
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    found = mix(whole, weights, max_epochs, seed, keep=("_row",))
    text = F.col("_row")["text"]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    fraction = F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")
    again = F.struct(text.alias("text"), F.col("_row")["n_chars"].cast("long").alias("n_chars"))
    cut = F.struct(fraction.alias("text"), F.length(fraction).cast("long").alias("n_chars"))
    each = F.explode(F.concat(F.array_repeat(again, F.col("copies")), F.array_repeat(cut, (F.col("part") > 0).cast("int"))))
    rows = found.select("_row", each.alias("_each"))
    return rows.select(*[F.col("_each" if c in ("text", "n_chars") else "_row")[c].alias(c) for c in docs.columns])


#: The rows of `mix` as SQL, from the definition and without ranges.
MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(sum(source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT max(level) FILTER (WHERE 3 * source_size >= weight * level) AS level FROM levels),
wanted AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < weight * l.level THEN CAST(3 * source_size AS DOUBLE) ELSE weight * h.level END AS target
  FROM levels l, held h),
placed AS (
  SELECT doc_id, size, h, w.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM docs d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source),
rests AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS rest FROM placed),
parts AS (SELECT *, greatest(least(rest - at_word, size), 0) AS again FROM rests),
copied AS (
  SELECT *, CAST(whole + CASE WHEN at_word < rest AND again = size THEN 1 ELSE 0 END AS INTEGER) AS copies,
         CAST(CASE WHEN at_word < rest AND again = size THEN 0 ELSE again END AS BIGINT) AS part
  FROM parts)
"""
