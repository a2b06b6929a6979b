"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only buckets above the byte limit are
split on another bit, until every shard fits.

The hash is of the row's id and text. A round sums bytes and rows by the next STEP bits of the prefixes still too large
and finds, for each of these cells, the shallowest prefix that fits (or holds a single row); cells that do not fit at the
deepest of these bits go to the next round. A round's table has at most 2^STEP cells for each prefix that was too large,
whatever the rows are, and rows are never gathered: they meet the directory by a join on their prefix.

Rows that agree in id and text have the same hash. If such a group alone is above the limit, it is split further by bits of
a hash of row numbers that were written beforehand. A single row above the limit is a shard of its own, marked over_limit.
Defined results: null text has no bytes; very long texts are measured whole; an empty table gives an empty table; other columns are ignored here and kept by
`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import join_small, packed, scratch, unpacked, written

STEP = 10
#: Bits of the hash of id and text, and of the row number's.
DEPTH, MORE = 60, 60


def _hash60(text):
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _round(rows: DataFrame, column: str, depth: int, within: list[str], limit: int, start: int = 0) -> DataFrame:
    """(within, cell, leaf): for each cell of STEP more bits its leaf's depth, null where it must split further."""
    fine = depth + STEP
    cells = rows.groupBy(*within, F.shiftright(column, 60 - fine).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    cells = written(cells, "cells")
    at = cells.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(depth + (depth > 0 or start > 0), fine + 1)])))
    at = at.withColumn("prefix", F.expr(f"shiftright(cell, {fine} - d)"))
    fits = at.groupBy(*within, "d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")).where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    leaf = at.join(fits, [*within, "d", "prefix"]).groupBy(*within, "cell").agg(F.min(F.struct("d", "shard_bytes", "shard_rows")).alias("leaf"))
    return written(cells.select(*within, "cell").join(leaf, [*within, "cell"], "left"), "directory")


def assign_shards(df: DataFrame, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_rows, over_limit."""
    key = F.concat(F.coalesce(df[id_col].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(df[text_col], F.lit(""))))
    rows = df.select(df[id_col].alias("__id"), F.coalesce(F.octet_length(df[text_col]), F.lit(0)).cast("long").alias("n_bytes"), _hash60(key).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows").withColumn("h2", _hash60(F.col("row").cast("string")))
    done: list[DataFrame] = []
    for column, within, start in (("h", [], 0), ("h2", ["h"], DEPTH)):
        for depth in range(0, DEPTH, STEP):
            book = _round(rows, column, depth, within, limit, start)
            found = book.agg(F.count("*").alias("all"), F.count("leaf").alias("settled")).first()
            met = join_small(rows.withColumn("cell", F.shiftright(column, 60 - depth - STEP)), book, [*within, "cell"], "inner", 64, found["all"])
            bits = F.expr(f"lpad(conv(shiftright({column}, 60 - leaf.d), 10, 2), leaf.d, '0')")
            name = F.when(F.col("leaf.d") == 0, F.lit("")).otherwise(bits)
            if start:
                name = F.concat(F.lpad(F.conv("h", 10, 2), DEPTH, "0"), name)
            done.append(met.where("leaf is not null").select("__id", "n_bytes", name.alias("shard"), (F.col("leaf.d") + start).alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_rows").alias("shard_rows"), "row"))
            if found["all"] == found["settled"]:
                break
            rows = written(met.where("leaf is null").drop("cell", "leaf"), "rows")
        else:
            continue
        break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("__id").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("over_limit"))


def write_shards(df: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write df with one folder per shard, named by its bits after a "b", in a column shard_bits (with leading underscores
    where df has one of that name); gives the column's name. Rows are numbered once and join their shard by number."""
    name = "shard_bits"
    while name in df.columns:
        name = f"_{name}"
    with scratch(df.sparkSession):
        rows = written(df.select(packed(df).alias("row"), F.monotonically_increasing_id().alias("rid"), df[text_col].alias("t")), "to-shard")
        named = assign_shards(rows.select("rid", "t"), limit, id_col="rid", text_col="t").select("rid", F.concat(F.lit("b"), "shard").alias("bits"))
        out = unpacked(rows.join(named, "rid"), "row", df.columns, F.col("bits").alias(name))
        out.repartition(name).write.partitionBy(name).parquet(path)
    return name


def oracle(limit: int) -> str:
    return rf"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), p AS (
  SELECT r.*, d, (h >> (60 - d)) AS prefix FROM r, (SELECT unnest(range(0, 61)) AS d)
), q AS (
  SELECT doc_id, n_bytes, h, d, prefix, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
  FROM p WINDOW w AS (PARTITION BY d, prefix)
), l AS (
  SELECT doc_id, n_bytes, h, min(d) AS d FROM q WHERE shard_bytes <= {limit} OR shard_rows = 1 GROUP BY ALL
)
SELECT q.doc_id, q.n_bytes, CASE WHEN l.d = 0 THEN '' ELSE lpad(bin(q.prefix), l.d::INT, '0') END AS shard, l.d::INT AS depth,
       q.shard_bytes::BIGINT AS shard_bytes, q.shard_rows::BIGINT AS shard_rows, q.shard_bytes > {limit} AS over_limit
FROM q JOIN l ON q.doc_id = l.doc_id AND q.d = l.d AND q.h = l.h
"""
