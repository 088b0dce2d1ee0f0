"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document into one bit of ``failed_bits``, beside the measurements it
was judged on. Policies are versioned bit masks over that ledger: changing a policy, or asking what a
rule costs, never touches a text again. Only built-in expressions run; no row leaves the JVM or its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import SPACE, documents, text_or_empty

#: Words in a window for repeats.
WINDOW = 5
#: Rule -> condition for failure over the measurements. The position in this list is the rule's bit.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("exclamations", "100 * n_exclaims > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    ("blank_lines", "n_lines >= 1 AND n_newlines > 20 * n_lines"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


def mask(*rules: str) -> int:
    return sum(1 << BIT[r] for r in rules)


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": mask(*BASE),
    "v2": mask(*BASE, "duplicate_lines", "symbols", "exclamations", "word_length"),
    "strict": mask(*(name for name, _ in RULES)),
}


def _count(text: Column, chars: str) -> Column:
    """Occurrences of any of the ASCII ``chars``: one byte search each, no regular expression."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, the measurements, and ``failed_bits`` (long).

    Null text counts as empty: no words, so ``few_words`` fails. A null or repeated id is carried as it
    is; other columns are ignored. An empty table gives an empty ledger.
    """
    text = F.col("t")
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    split = base.select(
        "doc_id",
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        (F.char_length(text) - _count(text, " \t\n\x0b\x0c\r")).alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        _count(text, "!").alias("n_exclaims"),
        _count(text, "\n").alias("n_newlines"),
    )
    n = F.size("words")
    hashed = split.select(
        "doc_id", "word_chars", "n_symbols", "n_exclaims", "n_newlines",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.col("words")[i + k] for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("win"),
    )
    keep = [c for c in hashed.columns if c != "win"]
    # only a text in which some window comes twice is sorted
    again = F.size(F.array_distinct("win")) < F.size("win")
    by_hash = hashed.select(
        *keep,
        F.when(again, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("e"),
    )
    same = lambda e, k: F.get(F.col("e"), k)["h"].eqNullSafe(e["h"])
    positions = by_hash.select(*keep, F.filter("e", lambda e, j: same(e, j - 1) | same(e, j + 1)).alias("e"))
    sorted_pos = positions.select(*keep, F.array_sort(F.transform("e", lambda e: e["i"])).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), j + 1) - p, F.lit(WINDOW))).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    measured = sorted_pos.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("long"))


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a versioned policy; a document that fails a base rule is never kept."""
    base = F.lit(mask(*BASE))
    bits = F.col("failed_bits")
    return led.withColumns(
        {
            "base_failed": bits.bitwiseAND(base) != 0,
            "kept": bits.bitwiseAND(F.lit(POLICIES[policy] | mask(*BASE))) == 0,
            "policy": F.lit(policy),
        }
    )


def ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """What each rule of a policy costs, from the ledger's bits alone: one row per rule.

    ``n_failed``: documents that fail the rule; ``n_only``: those that it alone rejects under the policy,
    so what dropping the rule would bring back. One pre-aggregated pass, one row per rule out.
    An empty ledger gives zero counts.
    """
    m = POLICIES[policy]
    bits = F.col("failed_bits")
    used = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if m >> i & 1]
    sums = led.agg(
        *(F.count_if(bits.bitwiseAND(F.lit(b)) != 0).alias(f"f{b}") for _, b in used),
        *(F.count_if(bits.bitwiseAND(F.lit(m)) == b).alias(f"o{b}") for _, b in used),
        F.count(F.lit(1)).alias("n"),
        F.bit_or(bits).alias("any_bits"),
    )
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"o{b}").alias("n_only"), F.col("n").alias("n_docs"), (F.coalesce(F.col("any_bits"), F.lit(0)).bitwiseAND(F.lit(b)) != 0).alias("ever")) for name, b in used))
    return sums.select(F.inline(rows))


def keep_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their columns as they were.

    The verdict is computed on the row itself, so nothing is shuffled or joined. The row number beside it
    keeps the optimizer from moving the filter below the measurements, which would repeat them in it.
    """
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text"))
    judged = apply_policy(ledger(row, id_col="row"), policy).select("doc_id", "kept", F.monotonically_increasing_id().alias("n"))
    return judged.where("kept AND n >= 0").select("doc_id.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


def _sql_count(chars: str) -> str:
    return f"CAST(length(t) - length(regexp_replace(t, '{chars}', '', 'g')) AS BIGINT)"


ORACLE = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM m)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS r
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
x AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         {_sql_count('[#*$%&|<>]')} AS n_symbols, {_sql_count('[!]')} AS ex, {_sql_count('[\n]')} AS nl,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words
  FROM m LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * ex > 50 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 16 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_lines >= 1 AND nl > 20 * n_lines THEN 64 ELSE 0 END) AS bits
  FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (bits & 63) = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits
FROM f
"""

def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standing policy costs over all documents."""
    return ablation(ledger(documents(spark, sf_dir)))


ABLATION = f"""
WITH f AS (SELECT failed_bits AS b FROM ({ORACLE})),
r(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(RULES) if POLICIES["v2"] >> i & 1)})
SELECT rule, count_if((b & bit) <> 0) AS n_failed, count_if((b & {POLICIES["v2"]}) = bit) AS n_only, count(b) AS n_docs, coalesce(bool_or((b & bit) <> 0), false) AS ever
FROM r LEFT JOIN f ON true GROUP BY rule
"""

QUERIES = {"op7_quality_rules": op7, "quality_ablation": quality_ablation}
ORACLES = {"op7_quality_rules": ORACLE, "quality_ablation": ABLATION}
