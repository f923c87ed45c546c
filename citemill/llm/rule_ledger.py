"""Quality rules: every rule is evaluated once into a ledger of failure bits.

A ledger row holds a document's measurements and one bit per failed rule. The ledger
is written once. Policies are versions: sets of rules that reject. Applying another
version, or asking what a rule does within one, reads only the written table.

Only column functions; one pass over the texts, no shuffle. Null text counts as
empty. Repeated rows give repeated ledger rows. Other columns of the input are
ignored. Windows of eight words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import BLANKS, WORD, staged, table, texts

WINDOW = 8
SYMBOL = r"[#*$%&|<>]+"
BLANK = r"[\x20\x09-\x0D]+"
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_stutters",
    "n_upper",
)


@dataclass(frozen=True)
class Rule:
    """A rule's name and the condition, in SQL over the measurements, that fails it."""

    name: str
    fails: str


RULES = (
    Rule("short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("upper_case", "10 * n_upper > 4 * word_chars"),
    Rule("stutter", "10 * n_stutters > 3 * n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
)
BASE = ("short", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "upper_case"),
    "v2": tuple(rule.name for rule in RULES),
}
CURRENT = "v2"


def mask(names: tuple[str, ...]) -> int:
    """The bits of these rules; rule i of ``RULES`` has bit i."""
    bits = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(bits[name] for name in names)


def _repeated_words(frame: DataFrame) -> DataFrame:
    """Add n_repeat_words, the words inside windows that occur at least twice.

    Window hashes sorted with their places put equal windows side by side; the
    places of those, in order, cover at most eight words each and overlap the next.
    """

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*(F.get("word_hashes", i + k) for k in range(WINDOW)))

    def doubled(item: Column, k: Column) -> Column:
        before, after = F.get("ordered", k - 1)["w"], F.get("ordered", k + 1)["w"]
        return F.coalesce(before == item["w"], F.lit(False)) | F.coalesce(after == item["w"], F.lit(False))

    def covered(place: Column, k: Column) -> Column:
        return F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - place, F.lit(WINDOW)))

    count = F.size("word_hashes")
    windows = F.transform(F.sequence(F.lit(0), count - WINDOW), window_hash)
    has_repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return (
        frame.withColumn("windows", F.when(count > WINDOW, windows))
        .withColumn("ordered", F.when(has_repeats, F.sort_array(pairs)))
        .withColumn("places", F.sort_array(F.transform(F.filter("ordered", doubled), lambda x: x["i"])))
        .withColumn(
            "n_repeat_words",
            F.coalesce(
                F.aggregate(F.transform("places", covered), F.lit(0), lambda total, x: total + x), F.lit(0)
            ).cast("long"),
        )
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and every measurement of each text."""
    with_words = docs.select("doc_id", texts(F.col("text")).alias("t")).select(
        "doc_id",
        "t",
        F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("word_hashes"),
        F.filter(F.split("t", "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0).alias("lines"),
    )

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace("t", pattern, "")).cast("long")

    def stutters(h: Column, k: Column) -> Column:
        return F.coalesce(F.get("word_hashes", k - 1) == h, F.lit(False))

    measured = _repeated_words(with_words).select(
        "doc_id",
        F.size("word_hashes").cast("long").alias("n_words"),
        without(BLANK).alias("word_chars"),
        (F.length("t") - without(SYMBOL)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("word_hashes", stutters)).cast("long").alias("n_stutters"),
        without(r"[^\p{Lu}]+").alias("n_upper"),
    )
    return measured.select("doc_id", *MEASURES)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def stored_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger, evaluated and written."""
    return staged(ledger(docs, rules), "rule-ledger")


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``kept``: no rule of this policy version failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(rows: DataFrame) -> DataFrame:
    """For each policy version and rule: rows that fail the rule, and rows that only it rejects.

    The ledger is first grouped by its bits, of which there are at most 2 to the
    number of rules, so nothing larger than that is expanded.
    """
    by_bits = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(
        *(
            F.struct(
                F.lit(version).alias("policy"),
                F.lit(name).alias("rule"),
                F.lit(mask(names)).cast("long").alias("policy_bits"),
                F.lit(mask((name,))).cast("long").alias("bit"),
            )
            for version, names in POLICIES.items()
            for name in names
        )
    )
    exploded = by_bits.select("fail_bits", "n", F.explode(cases).alias("c")).select("fail_bits", "n", "c.*")
    within = F.col("fail_bits").bitwiseAND(F.col("policy_bits"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return exploded.groupBy("policy", "rule").agg(
        total(within.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(within == F.col("bit")).alias("rejected_by_it_alone"),
        total(within != 0).alias("rejected_by_policy"),
        F.bit_or(within).alias("bits_seen"),
    )


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i+7], ' ')) AS n FROM places),
gaps AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS c FROM win WHERE n > 1),
rep AS (SELECT r, sum(c) AS n_repeat_words FROM gaps GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x, k: k > 1 AND words[k-1] = x)) AS n_stutters,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_upper > 4 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_stutters > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) AS fail_bits FROM m)
"""
SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, n_lines, n_stutters, n_upper, fail_bits::BIGINT AS fail_bits FROM b
"""


@register("op1_rule_ledger", SQL)
def op1_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = apply_policy(stored_ledger(table(spark, folder, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select(
        "doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", *MEASURES[5:], "fail_bits"
    )


ABLATION_SQL = _LEDGER_SQL + ", cases AS (" + " UNION ALL ".join(
    f"SELECT '{version}' AS policy, '{name}' AS rule, {mask(names)} AS policy_bits, {mask((name,))} AS bit"
    for version, names in POLICIES.items()
    for name in names
) + """)
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed,
  count(*) FILTER (fail_bits & policy_bits = bit) AS rejected_by_it_alone,
  count(*) FILTER (fail_bits & policy_bits <> 0) AS rejected_by_policy,
  CAST(bit_or(fail_bits & policy_bits) AS BIGINT) AS bits_seen
FROM b, cases GROUP BY policy, rule
"""


@register("rule_ablation", ABLATION_SQL)
def rule_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule does in each policy version, from the stored ledger of all documents."""
    return ablation(stored_ledger(table(spark, folder, "documents")))
