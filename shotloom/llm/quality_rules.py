"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Every rule is evaluated once per document; its failure sets one bit of ``failed``, and what the rules measured stays
beside it. A policy is a version and a mask of bits: a document passes if no masked bit is set, so policies are changed,
compared and ablated on the ledger, without reading a text again.

Words are runs of characters other than space and U+0009 to U+000D; lines are split at line feeds. Repeated windows are
found by 64-bit hashes of five words, inside each row: a text without a repeated hash costs one set of longs, and only
the others sort (hash, place) pairs. Nothing is shuffled.

Defined cases: a null text measures as the empty text, with no words, and fails ``few_words``; texts of under five words
have no windows; repeated rows give a row each; a null ``doc_id`` stays null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_wordy_lines", "n_loud_chars", "n_separators")


#: Rules in the order of their bits; a name, and when a document fails it.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("separators", "100 * n_separators > 20 * n_words"),
    ("shouting", "100 * n_loud_chars > 40 * word_chars"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_wordy_lines"),
    ("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of which rules count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[x] for x in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "separators", "shouting", "symbols", "duplicate_lines")),
        Policy("strict", tuple(BITS)),
    )
}
CURRENT = "v1"


def measures(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, the ``carry`` columns as they are, and what the rules measure of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), *carry, text.alias("text"), F.array_remove(F.split(text, "[ \\t-\\r]+"), "").alias("w"))
    hashes = F.when(
        F.size("w") >= WINDOW,
        F.expr(f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(-1, WINDOW - 1))}))"),
    ).otherwise(F.expr("array()").cast("array<bigint>"))
    lines = F.filter(F.split("text", "\\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    own = [c for c in df.columns if c not in ("text", "w")]
    df = df.select(
        *own,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        (F.size("w") - F.size(F.array_remove("w", "|"))).cast("long").alias("n_separators"),
        hashes.alias("h"),
    )
    df = df.withColumn("n_wordy_lines", F.size("lines").cast("long")).withColumn("n_loud_chars", F.expr("aggregate(lines, 0L, (s, x) -> s + if(x RLIKE '[A-Z]' AND NOT x RLIKE '[a-z]', char_length(x), 0))")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # (hash, place) pairs in order; a pair's hash is repeated if a neighbour has it
    ordered = "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    places = f"""
        aggregate(array({ordered}), CAST(array() AS ARRAY<INT>), (a, s) ->
            sort_array(transform(filter(
                transform(s, (x, k) -> struct(x.i AS i, coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false) AS twice)),
                x -> x.twice), x -> x.i)))"""
    # windows at places p1 < p2 < ... cover min(5, p2 - p1) + ... + 5 words
    covered = f"""
        if(size(array_distinct(h)) = size(h), 0L,
           aggregate({places}, struct(CAST(-{WINDOW} AS INT) AS last, 0L AS n),
                     (s, p) -> struct(p AS last, s.n + least({WINDOW}, p - s.last) AS n), s -> s.n))"""
    df = df.withColumn("n_repeat_words", F.expr(covered))
    # a generator of one row: filters on measurements stay above it, where below they would compute them again for every use
    return df.select(*own, F.inline(F.array(F.struct(*MEASURES))))


def ledger(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, ``failed`` (a bit per failed rule), the measurements, and the ``carry`` columns."""
    rows = measures(docs, *carry)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    failed = bits[0]
    for x in bits[1:]:
        failed = failed.bitwiseOR(x)
    return rows.select("*", failed.alias("failed"))


def apply_policy(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: none of the policy's rules failed."""
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version].mask)) == 0)


def ablation(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it."""
    policy = POLICIES[version]
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    rows = counts.select("f", "n", rules).select("f", "n", "r.rule", "r.bit")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with all their columns; each row stands on its own, so no join is needed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return apply_policy(ledger(docs, row), version).where("kept").select("row.*")
