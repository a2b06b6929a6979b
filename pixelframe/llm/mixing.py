"""Mixing sources to target weights by Pareto order sampling.

Sources weigh `weights`, repeated, in code-point order of their names (null last), and share all words by weight; a target
stops at `max_copies` times its source's words, and the excess is shared again by weight until none is above. A document
of a source with T target words out of S gets floor(T / S) certain whole copies. Of the rest, want = T - floor(T / S) * S
words, a Pareto order sample with unequal inclusion probabilities is drawn: with p = want / S, a document's inclusion odds
are p / (1 - p) * sqrt(mean size of its source / its size), so that the wanted words come from more documents and no long
one takes them all (a factor that a whole source shares changes no rank, so the odds need no calibration). Each document
has U from a hash of its id and text and ranks by (U / (1 - U)) / odds; the lowest ranks are taken up to the cut at which
the words taken come nearest to want (the fixed size, in words; of two equally near cuts the lower).

The cut is found without sorting a source in one task: words are summed by source and bins of the rank r, the first 8 bits
of r / (1 + r); the running sum over those at most 257 sums names the one bin where want is reached. That bin's rows are
summed by 8 more bits in the same way, and only the rows of the one bin found then are sorted. The cut lies near r = 1,
where bins are finest. A source's verdict is then a few numbers, joined back to the rows; rows themselves are never
shuffled.

Defined results: null text has size 0, and counts as size 1 in its odds; a source without words has target 0; rows that
agree in id and text share one U and are taken or left together; very long texts are counted whole; an empty table gives an
empty table; `take` keeps the columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import join_small, packed, scratch, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of U, and of the bins of ranks whose words are summed.
BITS, BIN_BITS = 52, 16


def unit_hash(id_col: Column, text: Column) -> Column:
    """52 bits of the row's hash, which stand for U = (bits + 0.5) / 2^52."""
    key = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """`rank` from 0 in the order of (__snull, __s): counts of range partitions, then a row number inside each, so that no
    task holds all sources. The counts are as many as partitions."""
    parts = written(sources.repartitionByRange(sources.sparkSession.sparkContext.defaultParallelism, "__snull", "__s").withColumn("__part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for part, n in sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    if not offsets:
        return parts.withColumn("rank", F.lit(0).cast("long"))
    at = sources.sparkSession.createDataFrame(offsets, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy("__snull", "__s")
    return parts.join(F.broadcast(at), "__part").withColumn("rank", F.row_number().over(w) - 1 + F.col("__before"))


def targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """(__snull, __s, source_size, filled, target): shares by weight, capped; the excess is shared again until none is
    above. `filled` counts the rows with words."""
    sources = sizes.groupBy("__snull", "__s").agg(F.sum("__size").alias("source_size"), F.count(F.when(F.col("__size") > 0, 1)).alias("filled"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(ranked(sources).withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.col("w") * level >= F.col("source_size") * max_copies
        row = sources.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * max_copies)), F.lit(0)), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if row[2] == capped or not row[1]:
            break
        level, capped = (total - row[0]) / row[1], row[2]
    return sources.select("__snull", "__s", "source_size", "filled", F.least(F.col("w") * level, F.col("source_size") * float(max_copies)).alias("target"))


def rank_value() -> Column:
    """A row's Pareto rank from its __u and __size and its source's want, source_size and filled; null where no sample is drawn."""
    unit = (F.col("__u") + 0.5) / float(1 << BITS)
    p = F.when(F.col("want") > 0, F.col("want") / F.col("source_size"))
    odds = (p / (1 - p)) * F.sqrt((F.col("source_size") / F.col("filled")) / F.greatest("__size", F.lit(1)))
    return (unit / (1 - unit)) / odds


def mixed(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Per row: `row` (its columns, as `packed` puts them), id, size, source_size, target, pareto (its rank; null where no
    sample is drawn) and copies (how often the mix takes it, 0 to max_copies)."""
    key, bin_of = ["__snull", "__s"], F.floor(F.col("pareto") / (1 + F.col("pareto")) * float(1 << BIN_BITS)).cast("int")
    rows = df.select(
        packed(df).alias("row"), df[id_col].alias("id"),
        F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("__size"), unit_hash(df[id_col], df[text_col]).alias("__u"),
        df[source_col].isNull().alias("__snull"), F.coalesce(df[source_col].cast("string"), F.lit("")).alias("__s"),
    )
    with scratch(df.sparkSession) as folder:
        sizes = written(rows.select(*key, "__size", "__u"), "sizes")
        plan = targets(sizes, weights, max_copies)
        sure = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        plan = written(plan.withColumn("sure", sure).withColumn("want", F.col("target") - F.col("sure") * F.col("source_size")), "plan")
        n_sources = plan.count()

        sampled = join_small(sizes, plan.where("want > 0"), key, "inner", 140, n_sources).withColumn("pareto", rank_value())
        sampled = sampled.select(*key, "want", "__size", "pareto", bin_of.alias("bin"))
        upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)

        def crossing(rows: DataFrame, name: str) -> DataFrame:
            """(key, bin, below, want): the bin in which each source's running words reach want, given those below all bins."""
            summed = rows.groupBy(*key, "want", "below", "bin").agg(F.sum("__size").alias("words"))
            reached = summed.withColumn("upto", F.col("below") + F.sum("words").over(upto)).where("upto >= want and upto - words < want")
            return written(reached.select(*key, "bin", (F.col("upto") - F.col("words")).alias("below"), "want"), name)

        half = BIN_BITS // 2
        coarse = crossing(sampled.withColumn("bin", F.shiftright("bin", half)).withColumn("below", F.lit(0).cast("long")), "coarse")
        fine = join_small(sampled.drop("want").withColumn("first", F.shiftright("bin", half)), coarse.withColumnRenamed("bin", "first"), [*key, "first"], "inner", 140, n_sources)
        bins = crossing(fine, "crossing")

        inside = join_small(sampled.drop("want"), bins, [*key, "bin"], "inner", 140, n_sources)
        inside = inside.groupBy(*key, "bin", "below", "want", "pareto").agg(F.sum("__size").alias("words"))
        inside = inside.select(*key, "bin", "want", "pareto", (F.col("below") + F.sum("words").over(Window.partitionBy(*key).orderBy("pareto"))).alias("upto"))
        none = bins.select(*key, "bin", "want", F.lit(-1.0).alias("pareto"), F.col("below").alias("upto"))
        cuts = inside.unionByName(none).groupBy(*key, "bin").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("want")).alias("off"), "pareto"))["pareto"].alias("cut"))

        verdict = written(plan.join(cuts.withColumnRenamed("bin", "cut_bin"), key, "left"), "verdict", folder)
    out = join_small(rows, verdict, key, "left", 180, n_sources).withColumn("pareto", rank_value())
    drawn = (bin_of < F.col("cut_bin")) | ((bin_of == F.col("cut_bin")) & (F.col("pareto") <= F.col("cut")))
    return out.select("row", "id", F.col("__size").alias("size"), "source_size", "target", "pareto", (F.col("sure") + F.when(drawn, 1).otherwise(0)).alias("copies"))


def report(df: DataFrame, **options) -> DataFrame:
    """Per row: the id, size, source_size, target, taken (words the mix takes, repeats counted), copies, pareto."""
    id_col = options.get("id_col", "doc_id")
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    got = mixed(df.select(id_col, text_col, source_col), **options)
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "pareto")


def take(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of df."""
    got = mixed(df, **options)
    return unpacked(got.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), "row", df.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS filled,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS capped, sum(w) OVER after AS left_w,
         (SELECT sum(source_size) FROM s) AS total
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((total - capped)::DOUBLE / left_w, 3 * source_size / w) AS l FROM o WHERE 3 * source_size / w >= (total - capped)::DOUBLE / left_w
), t AS (
  SELECT source, source_size, filled, least(w * l, 3.0::DOUBLE * source_size) AS target,
         CASE WHEN source_size > 0 THEN floor(least(w * l, 3.0::DOUBLE * source_size) / source_size) ELSE 0 END AS sure
  FROM s, level
), e AS (
  SELECT d.*, t.source_size, t.filled, t.target, t.sure, t.target - t.sure * t.source_size AS want, (d.u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS unit
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o2 AS (
  SELECT *, CASE WHEN want > 0 THEN want / source_size END AS p FROM e
), r AS (
  SELECT *, (unit / (1 - unit)) / ((p / (1 - p)) * sqrt((source_size / filled) / greatest(size, 1))) AS pareto FROM o2
), k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto) AS upto FROM r
), c AS (
  SELECT source, min({'off': abs(upto - want), 'upto': upto}).upto AS cut
  FROM (SELECT source, want, upto FROM k UNION ALL SELECT source, any_value(want), 0 FROM k GROUP BY source) GROUP BY source
)
SELECT doc_id, size, k.source_size::BIGINT AS source_size, k.target, pareto,
       ((k.sure + CASE WHEN k.want > 0 AND k.upto <= c.cut THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (k.sure + CASE WHEN k.want > 0 AND k.upto <= c.cut THEN 1 ELSE 0 END)::INT AS copies
FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source
"""
