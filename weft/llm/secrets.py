"""Secrets in texts: three fixed kinds, and strings whose characters are too evenly spread to be words.

Everything is a column expression: nothing leaves the JVM and nothing is shuffled.

Candidates are runs of 20 or more characters that keys are written in; without letters they are numbers,
and are left alone. By its characters a candidate is of class hex (hexadecimal digits, two digits at least),
mixed (letters and two digits at least) or letters (one digit at most), where runs that are spelt like words
are left alone, see wordlike. A
window of 20 characters slides over it. Shannon's entropy of a window is log2(W) - S / W with S the sum of
c * log2(c) over the counts c of its characters; a step of the window changes two counts, so S is kept up
by four table lookups and never counted anew. S is in millionths, as an integer, so no rounding builds up.
The stretch from the first window over the class's limit to the last is reported, unless the candidate is on
the allow-list. What the fixed kinds report is cut out of a candidate first; each part that is left and takes a
window is a candidate by itself."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import fresh, let, running

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: A run that is long enough begins where the run begins, so these find what the bare runs find, filtered.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Least bits a character of a window, by class.
LIMITS = {"hex": 3.0, "mixed": 3.7, "letters": 3.5}
#: Candidates in which one of these is found are examples, counters or names.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}|0{8,}",
    r"(?i)0123456789|123456789|abcdefgh|deadbeef",
    # words joined by _ or -, a number at most behind them; and paths. No group is repeated: Java's regular expressions
    # would go a call deeper for each part of a long candidate
    r"^(?=[A-Za-z]+[_-][A-Za-z])(?!.*[_-][_-])[A-Za-z_-]*[A-Za-z]([_-][0-9]{1,4})?$",
    r"^(?!.*//)/?[A-Za-z0-9_.-]+/[A-Za-z_.-]+/[A-Za-z_./-]*[A-Za-z_.-]$",
)
_SPAN = "struct<start: bigint, rank: int, end: bigint>"
_SCALE = 1_000_000


def weights(window: int = WINDOW) -> list[int]:
    """c * log2(c) in millionths for counts up to the window."""
    return [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, window + 1)]


def limit(bits: float, window: int = WINDOW) -> int:
    """The largest S of a window that has so many bits a character."""
    return math.floor(window * (math.log2(window) - bits) * _SCALE)


def _span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of a pattern's matches, leftmost and apart. The pieces between them give the offsets."""

    def spans(found, pieces):
        before = running(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i))))
        return let(before, lambda b: F.transform(found, lambda m, i: _span(F.get(b, i) + F.length(F.get(pieces, i)), rank, F.get(b, i) + F.length(F.get(pieces, i)) + F.length(m))))

    hit = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: spans(m, p)))
    return F.when(text.rlike(pattern), hit).otherwise(_none())


def base_spans(text: Column) -> Column:
    """The spans of the fixed kinds, by start, then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = lambda found: let(values, lambda v: F.filter(found, lambda s, i: F.length(F.get(v, i)) >= ASSIGN_LEAST))
    assigned = let(_matches(text, ASSIGN, 0), lambda found: F.when(F.size(found) > 0, long_enough(found)).otherwise(found))
    return F.array_sort(F.concat(assigned, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def _hot(word: Column, most: Column) -> Column:
    """The stretch (low, high) of a word's windows with S of at most `most`; null if there is none.

    The fold's state has the counts as a string, one character for each symbol from + to z, S, and the
    ends of the first and the last such window. The word is cut into codes once, so the time is in proportion to it."""
    first, symbols = 43, 80
    table = F.array(*[F.lit(w).cast("long") for w in weights()])
    zero = F.lit("@" * symbols)
    count = lambda counts, at: F.ascii(F.substring(counts, at + 1, F.lit(1))) - 64

    def put(counts, at, n):
        return F.overlay(counts, F.char(n + 64), at + 1, F.lit(1))

    def step(state, i, code):
        def came(at):
            def with_count(c):
                counts, total = put(state["counts"], at, c + 1), state["total"] + F.get(table, c + 1) - F.get(table, c)
                return F.struct(counts.alias("counts"), total.alias("total"))

            return let(count(state["counts"], at), with_count)

        def gone(now):
            at = F.get(code, i - WINDOW)

            def with_count(c):
                return F.struct(put(now["counts"], at, c - 1).alias("counts"), (now["total"] + F.get(table, c - 1) - F.get(table, c)).alias("total"))

            return F.when(i >= WINDOW, let(count(now["counts"], at), with_count)).otherwise(now)

        def judged(now):
            hot = (i >= WINDOW - 1) & (now["total"] <= most)
            return F.struct(
                now["counts"].alias("counts"), now["total"].alias("total"),
                F.when(hot & (state["low"] < 0), i - WINDOW + 1).otherwise(state["low"]).alias("low"), F.when(hot, i + 1).otherwise(state["high"]).alias("high"),
            )

        return let(let(let(F.get(code, i), came), gone), judged)

    start = F.struct(zero.alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    codes = F.transform(F.split(word, "", -1), lambda c: F.ascii(c) - first)
    folded = let(codes, lambda code: F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, lambda state, i: step(state, i, code)))
    return let(folded, lambda s: F.when(s["low"] >= 0, F.struct(s["low"].alias("low"), s["high"].alias("high"))))


def wordlike(word: Column) -> Column:
    """Whether a run of letters is spelt like words, whatever stands between them: a quarter of its letters are
    vowels, no five consonants stand together (h after some letters and the c of sch not counted), and capitals
    begin a word of two letters or more or stand together."""
    size = lambda pattern: F.length(F.regexp_replace(word, pattern, ""))
    spoken = F.regexp_replace(word, "(?i)(?<=[aeioucspt])h|(?<=s)c(?=h)", "")
    odd = word.rlike("(?<=[A-Z])[a-z](?![a-z])|(?<![a-z])[a-z](?=[A-Z])|(?<![A-Z])[A-Z]{2}(?=[a-z])")
    return (size("[^AEIOUYaeiouy]") * 4 >= size("[^A-Za-z]")) & ~spoken.rlike("(?i)[b-df-hj-np-tv-xz]{5}") & ~odd


def _parts(span: Column, word: Column, base: Column) -> Column:
    """The parts of a candidate (its span, its word) outside the base spans that take a window, as (start, word)."""

    def outside(cuts):
        starts = F.array_distinct(F.concat(F.array(span["start"]), F.transform(cuts, lambda b: b["end"])))
        free = F.filter(starts, lambda p: (p < span["end"]) & ~F.exists(cuts, lambda b: (b["start"] <= p) & (p < b["end"])))
        end = lambda p: F.coalesce(F.array_min(F.transform(F.filter(cuts, lambda b: b["start"] >= p), lambda b: b["start"])), span["end"])
        cut = F.transform(free, lambda p: F.struct(p.alias("start"), F.substring(word, (p - span["start"] + 1).cast("int"), (end(p) - p).cast("int")).alias("word")))
        return F.filter(cut, lambda x: F.length(x["word"]) >= WINDOW)

    whole = F.array(F.struct(span["start"].alias("start"), word.alias("word")))
    return let(F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])), lambda cuts: F.when(F.size(cuts) > 0, outside(cuts)).otherwise(whole))


def entropy_spans(text: Column, base: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of the hot stretches of what the base spans leave of the candidates."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def hot(word):
        hexadecimal = word.rlike("^[0-9a-fA-F]+$")
        letters = ~word.rlike("[0-9].*[0-9]")
        most = F.when(letters, F.lit(limit(LIMITS["letters"]))).when(hexadecimal, F.lit(limit(LIMITS["hex"]))).otherwise(F.lit(limit(LIMITS["mixed"])))
        known = F.lit(False)
        for pattern in allowed:
            known = known | word.rlike(pattern)
        return F.when(word.rlike("[A-Za-z]") & ~known & ~(letters & wordlike(word)), let(most, lambda m: _hot(word, m)))

    def judged(spans):
        parts = let(found, lambda words: F.flatten(F.transform(spans, lambda s, i: _parts(s, F.get(words, i), base))))
        stretches = F.transform(parts, lambda p: let(hot(p["word"]), lambda h: F.when(h.isNotNull(), _span(p["start"] + h["low"], 3, p["start"] + h["high"]))))
        return F.filter(stretches, lambda s: s.isNotNull())

    return F.when(text.rlike(CANDIDATE), let(_matches(text, CANDIDATE, 3), judged)).otherwise(_none())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """(doc_id, base, spans) for each row of docs: arrays of (start, rank of the kind, end) in code points,
    end exclusive, by start, then kind.

    A null text is an empty one, without spans. Null and repeated doc_ids are rows like others; an empty
    table gives no rows; other columns are not read. Texts and tokens are scanned whole, however long, in time in
    proportion to them."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("more", entropy_spans(F.col("text"), F.col("base"), allowed))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """docs with every span in text replaced by the mark (overlapping spans by one); other columns and
    rows stay as they are, null, empty and repeated ones too. Where n_chars is a column it follows the text."""
    base, spans = fresh(docs, "_base"), fresh(docs, "_spans")
    text = F.col("text")
    rows = docs.withColumn(base, base_spans(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn(spans, F.concat(F.col(base), entropy_spans(F.coalesce(text, F.lit("")), F.col(base), allowed)))

    def covered(state, s):
        apart = s["start"] > state["end"]
        closed = F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))
        return F.struct(
            F.when(apart, closed).otherwise(state["done"]).alias("done"),
            F.when(apart, s["start"]).otherwise(state["start"]).alias("start"), F.greatest(state["end"], s["end"]).alias("end"),
        )

    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    nil = F.struct(empty.alias("done"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    merged = F.aggregate(F.array_sort(F.col(spans)), nil, covered, lambda s: F.concat(F.slice(s["done"], F.lit(2), F.size(s["done"])), F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def cut(m):
        piece = lambda i: F.substring(text, (F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0)) + 1).cast("int"), (F.when(i < F.size(m), F.get(m, i)["start"]).otherwise(F.length(text)) - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0))).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), piece), mark)

    clean = F.when(F.size(spans) > 0, let(merged, cut)).otherwise(text)
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop(base, spans)
