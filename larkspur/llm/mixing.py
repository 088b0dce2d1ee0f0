"""Mixing sources to target weights by capped water-filling.

Each source gets its weight's share of all words, but never more than ``cap`` times what it holds; what
a clamped source cannot take is reshared by weight among the others until none is above its cap. A
document is then repeated whole as often as every document of its source, and the remaining words come
from one more repetition of the source's documents in a seeded order, the last one entered being cut, so
that a source's taken words meet its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import WORD, documents, staged, text_or_empty

CYCLE = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Between a word's last character and white space: pieces of a text cut there are white space and one word.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Hex digits of a document's seeded digest that name its bucket: a source's running sum is taken over
#: buckets first and then inside each, so no task holds a source. 16**3 buckets a source.
BUCKET_HEX = 3


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """Water-filled targets: skey, source_size, target (double). ``sizes`` has skey, source and source_size.

    In order of cap over weight the clamped sources come first, so one running sum finds the level. The
    windows go over one row per source, never over documents; all sources are in one task, some 60 bytes each,
    so this holds for millions of sources and not for one per document.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = sizes.withColumn("n", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle))
    w = w.select("skey", "source_size", F.element_at(F.array(*(F.lit(float(c)) for c in cycle)), F.col("n") + 1).alias("weight"))
    w = w.withColumn("limit", (F.col("source_size") * cap).cast("double"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(from_here),
        }
    )
    w = w.withColumn("clamped", F.col("limit") * F.col("rest") <= F.col("weight") * F.col("left"))
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("limit") / F.col("weight"), F.col("skey"), F.col("left") / F.col("rest")))).over(everything)
    return w.withColumn("level", level["col3"]).select(
        "skey", "source_size", F.when(F.col("clamped"), F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def plan_mix(docs: DataFrame, seed: str = SEED, cap: int = CAP, carry: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, whole, part, taken, and ``carried``.

    Null text has size 0 and null source is a source of its own, ranked last. ``whole`` is how often the
    text is taken whole, ``taken`` the words taken in all. ``carry``, if given, is a column that goes along
    with its row. Each row counts for itself, with a null or repeated id too; rows of equal id tie and are
    ordered by size and text, so reruns agree on the result as a set, and are sorted by one task. Nothing is
    broadcast: hot sources are dealt over ``16**BUCKET_HEX`` buckets each. An empty table gives an empty plan.
    """
    sized = staged(
        docs.select(
            *([carry.alias("carried")] if carry is not None else []),
            F.xxhash64(text_or_empty()).alias("tie"),
            F.col("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("skey"),
            F.col("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
        ),
        "mix-sizes",
    ).withColumn("bucket", F.substring("draw", 1, BUCKET_HEX))
    buckets = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    # summed from buckets, so a hot source sends each task's few thousand sums and not its rows
    sizes = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, cap=cap)
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("offset")).join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = (
        sized.join(offsets, ["skey", "bucket"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("whole", rate)
        .withColumn("more", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("before"))).cast("long")
    carried = ["carried"] if carry is not None else []
    return placed.select(*carried, "doc_id", "source", "size", "source_size", "target", "whole", part.alias("part"), (F.col("whole") * F.col("size") + part).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED, cap: int = CAP) -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated; a cut last repetition is its text through the last word taken, with its own n_chars.

    Columns are those of ``docs``. Rows go along with their plan and are never joined to it, so null and
    repeated ids neither lose nor multiply rows. A document without words has nothing to take and leaves the mix.
    """
    cols = docs.columns
    plan = plan_mix(docs, seed, cap, F.struct(*(F.col(f"`{c}`") for c in cols))).where("taken > 0")
    times = F.col("whole").cast("int") - F.when(F.col("part") > 0, 0).otherwise(1)
    out = plan.select("carried", "size", "whole", "part", F.explode(F.sequence(F.lit(0), times)).alias("k"))
    cut = (F.col("k") == F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.split("carried.text", WORD_END)
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("carried.text"))
    made = {"text": text}
    if "n_chars" in cols:
        made["n_chars"] = F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("carried.n_chars"))
    return out.select(*(made.get(c, F.col(f"carried.`{c}`")).alias(c) for c in cols))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '~') AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * {CAP} AS DOUBLE) AS lim FROM s),
r AS (
  SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - coalesce(sum(lim) OVER (ORDER BY lim / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lft,
         sum(weight) OVER (ORDER BY lim / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
c AS (SELECT *, lim * rest <= weight * lft AS clamped FROM r),
t AS (
  SELECT skey, source_size, CASE WHEN clamped THEN lim ELSE weight * (SELECT lft / rest FROM c WHERE NOT clamped ORDER BY lim / weight, skey LIMIT 1) END AS target
  FROM c),
p AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(CAST(sum(size) OVER (PARTITION BY skey ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op10_mix": op10}
ORACLES = {"op10_mix": ORACLE}
