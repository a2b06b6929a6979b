r"""Quality rules with verdicts on hosts, in DataFrame functions only.

A row's rules look at its whole text: words are runs of `[^\x20\x09-\x0D]`. Repetition is found inside the row: the text's
3-word windows are hashed and sorted with their places, and only windows whose hash has a neighbour are compared as text,
so the count is exact and the work is n log n for long texts. Nothing but counts leaves a row.

Host rules: failures are summed by host (partial sums first, so a hot host is no hot task). The hosts' rates get a Beta
prior by the method of moments (the spread between hosts beyond what chance gives), and a host's shrunk rate is
(failed + a) / (rows + a + b). Hosts above `max_rate` are rejected with all their rows; shrinking keeps small hosts near
the corpus's rate. Verdicts go back to rows by a join on the host: broadcast if counted small, else sort-merge, whose
skewed partitions AQE splits.

Defined results: null text has no words and fails; a null host is a host of its own; repeated rows are judged alike and
count each; very long texts are measured whole; an empty table gives an empty table; other columns are ignored by `report`
and kept by `keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import join_small, packed, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Place bits beside the hash in a sorted value; longer texts compare all windows as text.
PLACE = 24


def _window_text(p: Column) -> Column:
    """Window p and its place; a tab cannot be in a word, so equal windows stand together when sorted."""
    return F.concat(F.get("__words", p), F.lit(" "), F.get("__words", p + 1), F.lit(" "), F.get("__words", p + 2), F.lit("\t"), p.cast("string"))


def _beside(column: str, of) -> Column:
    """The sorted array's elements that have an equal neighbour in what `of` takes from them."""
    return F.filter(column, lambda x, i: (of(x) == of(F.get(column, i - 1))) | (of(x) == of(F.get(column, i + 1))))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, each with two leading underscores."""
    text = F.coalesce(df[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({
        "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "__n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "__lines": lines,
    })
    out = out.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__at": F.when(F.size("__words") > 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>")),
    }).drop("__lines")
    mask = (1 << PLACE) - 1
    code = lambda p: F.xxhash64(F.get("__words", p), F.get("__words", p + 1), F.get("__words", p + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(p.cast("long"))
    short = F.size("__words") <= mask
    out = out.withColumn("__coded", F.when(short, F.sort_array(F.transform("__at", code))))
    near = _beside("__coded", lambda x: F.shiftright(x, PLACE))
    out = out.withColumn("__maybe", F.when(short, F.transform(near, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))).otherwise(F.col("__at")))
    out = out.withColumn("__shown", F.sort_array(F.transform("__maybe", _window_text)))
    same = _beside("__shown", lambda x: F.substring_index(x, "\t", 1))
    out = out.withColumn("__places", F.sort_array(F.transform(same, lambda x: F.substring_index(x, "\t", -1).cast("int"))))
    cover = F.aggregate(F.transform("__places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__places", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("__n_repeat_words", cover).drop("__words", "__at", "__coded", "__maybe", "__shown", "__places")
    return out.withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words")))


def host_rates(rows: DataFrame) -> DataFrame:
    """(__hnull, __host, host_rows, host_failed, host_rate) with host_rate shrunk by the empirical Beta prior."""
    hosts = written(rows.groupBy("__hnull", "__host").agg(F.count("*").alias("host_rows"), F.sum(F.col("__base_failed").cast("long")).alias("host_failed")), "hosts")
    got = hosts.agg(F.count("*").alias("h"), F.sum("host_rows").alias("n"), F.sum("host_failed").alias("k"), F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_rows")).alias("q")).first()
    if not got["n"]:
        return hosts.withColumn("host_rate", F.lit(0.0))
    n, m = got["n"], got["k"] / got["n"]
    spread = got["q"] / n - m * m - m * (1 - m) * got["h"] / n
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.withColumn("host_rate", (F.col("host_failed") + m * strength) / (F.col("host_rows") + strength))


def report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.75) -> DataFrame:
    """Per row: the id, the measures, base_failed, host_rate and kept. The measures are written once and read twice."""
    rows = measured(df.select(df[id_col].alias("__id"), df[text_col].alias("__text"), F.col(host_col).isNull().alias("__hnull"), F.coalesce(df[host_col].cast("string"), F.lit("")).alias("__host")), "__text").drop("__text")
    rows = written(rows, "measures")
    hosts = written(host_rates(rows), "rates")
    out = join_small(rows, hosts, ["__hnull", "__host"], "left", 80)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__{n}").alias(n) for n in names], "host_rate", (~F.col("__base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"))


def keep(df: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = 0.75) -> DataFrame:
    """The rows of df that pass their own rules and whose host passes. Texts are measured once: rows with their verdicts
    are written (those that fail without their columns, as they only count for their host) and read twice."""
    key = [df[host_col].isNull().alias("__hnull"), F.coalesce(df[host_col].cast("string"), F.lit("")).alias("__host")]
    rows = measured(df.select(packed(df).alias("__row"), df[text_col].alias("__text"), *key), "__text")
    rows = written(rows.select(F.when(~F.col("__base_failed"), F.col("__row")).alias("__row"), "__hnull", "__host", "__base_failed"), "judged")
    hosts = written(host_rates(rows), "rates").where(F.col("host_rate") <= max_rate).select("__hnull", "__host")
    return unpacked(join_small(rows.where("not __base_failed"), hosts, ["__hnull", "__host"], "inner", 80), "__row", df.columns)


def oracle(max_rate: float = 0.75) -> str:
    return rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g
), p AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) LEFT JOIN p USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source
), a AS (
  SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM h
), s AS (
  SELECT m, q / n - m * m - m * (1 - m) * h / n AS spread FROM a
), x AS (
  SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM s
), r AS (
  SELECT source, (f + m * strength) / (n + strength) AS host_rate FROM h, x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= {max_rate} AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
