"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once. The ledger holds the measurements and one bit for each rule
that failed; a policy is a version with a mask of the rules that count, so another policy, or
the effect of leaving a rule out, is read from the bits without looking at a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.llm.frames import unused

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule to its bit, in order.
RULES = ["few_words", "repeated_words", "repeated_lines", "symbols", "short_words", "long_words"]
BITS = {rule: 1 << i for i, rule in enumerate(RULES)}


def mask(*rules: str) -> int:
    return reduce(lambda bits, rule: bits | BITS[rule], rules, 0)


#: Version to the mask of the rules that reject a document.
POLICIES = {
    1: mask("few_words", "repeated_words"),
    2: mask("few_words", "repeated_words", "repeated_lines", "symbols", "short_words", "long_words"),
}
BASE, CURRENT = 1, 2
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words(text: Column) -> Column:
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(found: Column) -> Column:
    """Words of array ``found`` that lie in a WINDOW-word window that occurs twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def windows(hashes: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)

    def again(placed: Column) -> Column:
        near = lambda x, k: x["h"].eqNullSafe(F.get(placed, k)["h"])
        return F.filter(placed, lambda x, k: near(x, k - 1) | near(x, k + 1))

    def covered(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        starts = F.sort_array(F.transform(_let(F.sort_array(pairs), again), lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct(
            (s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")
        )
        return F.aggregate(starts, begin, step, lambda s: s["n"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    of_words = F.transform(found, lambda word: F.xxhash64(word))
    return F.when(F.size(found) > WINDOW, _let(_let(of_words, windows), count)).otherwise(F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES (bigint); null counts as empty. Columns so named are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: _without(line, SPACES) != "")
    kept = [c for c in docs.columns if c not in MEASURES]
    found_words, found_lines = unused("found words", docs.columns), unused("found lines", docs.columns)
    inner = docs.select(
        *(docs[c] for c in kept),
        words(whole).alias(found_words),
        lines.alias(found_lines),
        F.length(_without(whole, SPACES)).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("bigint").alias("n_symbols"),
    )
    number = lambda column: column.cast("bigint")
    return inner.select(
        *(inner[c] for c in inner.columns if c not in (found_words, found_lines)),
        number(F.size(found_words)).alias("n_words"),
        number(F.size(found_lines)).alias("n_lines"),
        number(F.size(found_lines) - F.size(F.array_distinct(found_lines))).alias("n_dup_lines"),
        number(repeated_words(F.col(f"`{found_words}`"))).alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """Rule to its condition on MEASURES; all in whole numbers."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "symbols": 100 * F.col("n_symbols") > 10 * chars,
        "short_words": chars < 2 * n,
        "long_words": chars > 20 * n,
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with MEASURES and ``failure_bits``, one bit a failed rule.

    Columns so named are replaced, all others stay.
    """
    bits = [F.when(condition, F.lit(BITS[rule])).otherwise(F.lit(0)) for rule, condition in failures().items()]
    rows = measured(docs, text)
    kept = [c for c in rows.columns if c not in (text, "failure_bits")]
    return rows.select(*kept, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint").alias("failure_bits"))


def passes(version: int, without: str | None = None) -> Column:
    """Whether a ledger row passes a policy, perhaps without one of its rules."""
    rules = POLICIES[version] & ~(BITS[without] if without else 0)
    return F.col("failure_bits").bitwiseAND(F.lit(rules)) == 0


def judged(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version.

    A null or empty text has no words and fails; rows stay as they are, with repeated ones;
    columns named like the new ones are replaced; an empty table stays empty.
    """
    return rows.select(
        *(rows[c] for c in rows.columns if c not in ("base_failed", "kept", "policy_version")),
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(version)).alias("kept"),
        F.lit(version).alias("policy_version"),
    )


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule, how many documents fail, and how many through that rule alone.

    Rows collapse to their distinct bit patterns before any policy is looked at.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(v).alias("policy_version"), F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit"), F.lit(m).alias("rules"))
        for v, m in POLICIES.items() for r in RULES if m & BITS[r]
    ]
    each = patterns.select("failure_bits", "n", F.inline(F.array(*cases)))
    failed = F.col("failure_bits").bitwiseAND(F.col("rules"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("policy_version", "rule").agg(
        F.sum("n").alias("n_docs"),
        count(failed != 0).alias("n_failed"),
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_rule_failed"),
        count(failed == F.col("bit")).alias("n_only_rule"),
    )
