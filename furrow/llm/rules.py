"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer whose bit i is set if rule i fails. A policy is a named, versioned set of
rules, that is a mask: a document passes it if ledger AND mask is 0. Ablations (what a
rule removes alone, what a policy keeps without it) are bit operations and sums over
the ledger; no text is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule names in bit order; new rules go at the end so that old ledgers stay valid.
RULES = ["too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length"]

#: Versioned policies: the rules that each enforces.
POLICIES = {
    "base-1": ["too_few_words", "repeated_windows"],
    "strict-1": ["too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length"],
}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every whole text.

    Words are runs of anything but ASCII white space. n_repeat_words counts the words
    covered by 3-word windows that occur twice or more in the text, by sorting each
    document's window hashes in place: no window leaves its row. Windows of one text are
    told apart by 64-bit hashes: two different ones among n are taken for equal with a
    chance of n * n / 4e19, 1e-14 for a text of 600 words. Null and empty texts have no
    words; very long texts are measured whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # one trim first, so that split gives no empty word at either end
    trimmed = F.trim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    step1 = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).select(
        "id",
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.size("h")
    # arrays_zip of the hashes and their shifts gives each window without indexing
    windows = F.transform(
        F.arrays_zip("h", F.slice("h", 2, F.greatest(n - 1, F.lit(0))).alias("h2"), F.slice("h", 3, F.greatest(n - 2, F.lit(0))).alias("h3")),
        lambda x, i: F.struct(F.xxhash64(x["h"], x["h2"], x["h3"]).alias("k"), i.alias("i")),
    )
    step2 = step1.select(
        "id",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.when(n >= 3, F.array_sort(F.slice(windows, 1, F.greatest(n - 2, F.lit(0))))).alias("s"),
    )
    return step2.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(_covered(F.col("s")), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
    )


def _covered(s: Column) -> Column:
    """Words under repeated windows, from the sorted (key, position) array."""
    keys = s["k"]
    m = F.size(s)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(keys, 1, F.greatest(m - 1, F.lit(0))))
    after = F.slice(keys, 2, F.greatest(m - 1, F.lit(0)))
    zipped = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
    starts = F.transform(F.filter(zipped, lambda x: (x["s"]["k"] == x["b"]) | (x["s"]["k"] == x["a"])), lambda x: x["s"]["i"])
    # starts in text order; each covers 3 words less the overlap with the one before
    return F.aggregate(
        F.array_sort(starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() plus fail_bits: bit i set if RULES[i] fails.

    Null and empty texts have no words and fail too_few_words only. Repeated rows repeat.
    """
    fails = [
        F.col("n_words") < 50,
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        2 * F.col("n_symbols") > F.col("n_words"),
        (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        (F.col("word_chars") > 20 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    ]
    bits = sum((F.when(fail, F.lit(1 << i)).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def judge(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with base_failed (the first policy's rules) and kept under the named policy."""
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base-1"))) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask("base-1") | mask(policy))) == 0
    )


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of a policy: documents failing it, failing it alone, and kept without it.

    Also any_bits and all_bits, the OR and AND of the ledger. A fixed number of sums
    in one aggregation; an empty ledger gives zeros and null bits.
    """
    enforced = mask(policy)
    held = F.col("fail_bits").bitwiseAND(F.lit(enforced))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    one = rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        count(held == 0).alias("n_kept"),
        F.bit_or("fail_bits").alias("any_bits"),
        F.bit_and("fail_bits").alias("all_bits"),
        F.array(
            *(
                F.struct(
                    F.lit(rule).alias("rule"),
                    count(held.bitwiseAND(F.lit(1 << RULES.index(rule))) != 0).alias("n_failing"),
                    count(held == (1 << RULES.index(rule))).alias("n_failing_alone"),
                    count(held.bitwiseAND(F.lit(enforced & ~(1 << RULES.index(rule)))) == 0).alias("n_kept_without"),
                )
                for rule in POLICIES[policy]
            )
        ).alias("r"),
    )
    return one.select(F.lit(policy).alias("policy"), "n_docs", "n_kept", "any_bits", "all_bits", F.inline("r"))
