"""Quality rules as a ledger of bits.

Every rule is evaluated once, over the whole text; the ledger keeps what was measured and one bit for
each rule that failed. A policy is a version, a mask of the rules that it applies, and nothing else: to
apply another policy, or to ask what a rule does beside the others, is integer arithmetic on the ledger
and never reads a text again."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marked_words")
#: One row each: the rule's name, in the order of its bits, and when a document fails it (integers only, so
#: that a measurement on the line is decided alike everywhere).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("capitals", "100 * n_upper > 50 * n_letters"),
    ("marked_words", "100 * n_marked_words > 50 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """The rules in `mask` reject; `allowed` of them may fail beside the base rules."""

    version: int
    mask: int
    allowed: int = 0


POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, sum(BIT.values())),
    3: Policy(3, sum(BIT.values()) & ~BIT["word_length"], allowed=1),
}
CURRENT = 2

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text. Words are runs of bytes other than ASCII white space; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, _SPACES)
    chars = len(solid.decode("utf-8", "surrogatepass"))
    seen, repeated, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    covered = 0
    windows = [*zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)]
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0  # the first word that no repeated window has covered yet
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered += i + 5 - max(i, end)
                end = i + 5
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-2:-1] == w[-1:] for w in words)
    return n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), repeated, covered, lines, upper, upper + lower, marked


def measured(text: Column) -> Column:
    """measure as a column: a struct of longs."""

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES))
    def of(texts):
        import pyarrow as pa

        columns = [*zip(*(measure(t.as_py()) for t in texts), strict=True)] or [()] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)

    return of(text)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed) for each row of docs; failed has a rule's bit where it failed.

    A null text is one without words. Null and repeated doc_ids are rows like others; an empty table gives
    no rows; other columns are not read."""
    rows = docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed.cast("int"))


def verdict(policy: Policy) -> Column:
    """Whether a row of the ledger passes."""
    base, rest = policy.mask & BASE, policy.mask & ~BASE
    return (F.col("failed").bitwiseAND(F.lit(base)) == 0) & (F.bit_count(F.col("failed").bitwiseAND(F.lit(rest))) <= policy.allowed)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with columns policy and kept."""
    return rows.withColumn("policy", F.lit(version)).withColumn("kept", verdict(POLICIES[version]))


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """What each rule of a policy does: (rule, policy, rejected, n_failed, n_alone, n_kept_without).

    rejected: rows that the policy rejects; n_failed: rows that fail the rule; n_alone: rejected rows that
    would be kept without it; n_kept_without: all rows kept without it. Rows are first counted by their
    bits (at most 2^rules groups), and all rules are answered from those counts."""
    policy = POLICIES[version]
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    kept = verdict(policy)
    aggs = [F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("rejected")]
    for i, _ in rules:
        without = verdict(Policy(policy.version, policy.mask & ~(1 << i), policy.allowed))
        hit = F.col("failed").bitwiseAND(F.lit(1 << i)) != 0
        aggs += [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{k}{i}") for k, c in (("f", hit), ("a", without & ~kept), ("k", without))]
    one = counts.agg(*aggs)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    answers = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(version).alias("policy"), zero("rejected").alias("rejected"), zero(f"f{i}").alias("n_failed"), zero(f"a{i}").alias("n_alone"), zero(f"k{i}").alias("n_kept_without")) for i, name in rules])
    return one.select(F.inline(answers))
