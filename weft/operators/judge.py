"""Candidate pairs judged: by shared domain terms, or by a callable that asks a model."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.numbers import half_even
from weft.functions.text import domain_tokens
from weft.operators.similarity import cosine_pairs
from weft.schema import PLAYS

THRESHOLD = 0.82


def evaluated(similarity: Column, terms_a: Column, terms_b: Column, owner_a: Column, owner_b: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    """Columns confirmed, confidence, play and reason. Two shared terms confirm, or one with high similarity."""
    common = F.array_intersect(terms_a, terms_b)
    return verdict(similarity, F.size(common), F.size(F.array_union(terms_a, terms_b)), F.array_join(F.slice(F.array_sort(common), 1, 3), ", "), owner_a == owner_b, threshold)


def verdict(similarity: Column, n: Column, total: Column, first: Column, same_owner: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    """The columns of evaluated from how many terms both have, how many there are in all, and the first three that both have, as one text."""
    confirmed = (n >= 2) | ((n >= 1) & (similarity >= threshold))
    share = F.least(similarity, 0.5 + n / F.greatest(total, F.lit(1)))
    two = F.format_number(similarity, 2)  # of the double itself, halves to even, as printf in C; format_string rounds 0.435, which lies below its digits, up
    return {
        "confirmed": confirmed,
        "confidence": half_even(F.when(confirmed, share).otherwise(F.least(similarity, F.lit(0.4))), 2),
        "play": F.when(confirmed & same_owner, "RETIRE").when(confirmed, "STANDARDIZE").otherwise("LEAVE"),
        "reason": F.when(confirmed, F.concat(F.lit("Both speak of "), first, F.lit("; their summaries have cosine "), two)).otherwise(
            F.concat(F.lit("Too little in common: "), n.cast("string"), F.lit(" terms, cosine "), two)
        ),
    }


def judged(candidates: DataFrame, summaries: DataFrame, owners: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """candidates (a, b, similarity) with terms and owners of both sides looked up, and the verdict.

    A module without a summary is summarised by its id, one without an owner belongs to 'unknown'."""
    facts = summaries.join(owners.select("module_id", "owner"), "module_id", "full")
    out = candidates
    for side in ("a", "b"):
        mine = facts.select(F.col("module_id").alias(side), F.col("summary").alias(f"summary_{side}"), F.col("owner").alias(f"owner_{side}"))
        out = out.join(mine, side, "left").withColumns({f"owner_{side}": F.coalesce(f"owner_{side}", F.lit("unknown")), f"terms_{side}": domain_tokens(F.coalesce(f"summary_{side}", F.col(side).cast("string")))})
    verdict = evaluated(F.col("similarity"), F.col("terms_a"), F.col("terms_b"), F.col("owner_a"), F.col("owner_b"), threshold)
    return out.withColumns(verdict).drop("terms_a", "terms_b")


def _packed(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        import zlib

        return pa.array([zlib.compress((t or "").encode(), 1) for t in texts.to_pylist()], pa.binary())

    return of(text)


def shared_terms(table: pa.Table) -> Callable:
    """told for cosine_pairs over rows with terms (packed, each with a blank after it, in order) and owner: n_common, n_terms, first and
    same_owner, as verdict takes them. A term that one row alone has is counted only, as no pair shares it."""
    import zlib

    import numpy as np
    import pyarrow.compute as pc

    numbers, parts = {}, []
    for at in range(0, len(table), 8192):
        texts = [zlib.decompress(t) for t in table["terms"].slice(at, 8192).to_pylist()]
        found = pc.split_pattern(pa.array([b"".join(texts).decode()], pa.large_string()), " ")[0].values[:-1].dictionary_encode()
        codes = np.array([numbers.setdefault(t, len(numbers)) for t in found.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int32)[found.indices.to_numpy()]
        parts.append((np.array([t.count(b" ") for t in texts]), codes))
    words, held = np.array([*numbers], dtype=object), np.zeros(len(numbers), np.int64)
    for _, codes in parts:
        held += np.bincount(codes, minlength=len(held))
    often = np.argsort(-held, kind="stable")[: (held > 1).sum()]  # what many have is side by side
    place = np.full(len(words), -1, np.int32)
    place[often], words = np.arange(len(often)), words[often]
    sizes, lengths, every = [], [], []
    while parts:  # a part of the rows at a time
        many, codes = parts.pop(0)
        codes = place[codes]
        sizes.append(many)
        lengths.append(np.diff(np.concatenate([[0], np.cumsum(codes >= 0)])[np.concatenate([[0], np.cumsum(many)])]))
        every.append(codes[codes >= 0])
    sizes, lengths, every = (np.concatenate(v) for v in (sizes, lengths, every))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owners = table["owner"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    marks = np.zeros(len(words), np.uint64)  # of each term, which of up to 64 rows have it

    def spread(at):
        """The places in every of the terms of rows `at`, and how many each has."""
        many = lengths[at]
        return np.repeat(starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum()), many

    def part(a, b):
        known, row = np.unique(a, return_inverse=True)
        for k, r in enumerate(known.tolist()):
            marks[every[starts[r] : ends[r]]] |= np.uint64(1 << k)
        where, many = spread(b)
        hits = np.flatnonzero(marks[every[where]] & np.repeat(np.uint64(1) << row.astype(np.uint64), many))
        marks[every[spread(known)[0]]] = 0
        upto = np.searchsorted(hits, np.cumsum(many))
        n = np.diff(upto, prepend=0)
        few = np.minimum(n, 3)
        at = np.cumsum(few)
        said = words[every[where[hits[np.repeat(upto - n - at + few, few) + np.arange(few.sum())]]]].tolist()
        return n, [", ".join(said[e - k : e]) for e, k in zip(at.tolist(), few.tolist(), strict=True)]

    def of(a, b):
        # pairs come by their row a: parts have at most 64 of them, and some million terms
        step = np.cumsum(np.diff(a, prepend=a[:1]) != 0) // 64, np.cumsum(lengths[b]) // (1 << 20)
        cuts = np.flatnonzero((np.diff(step[0]) != 0) | (np.diff(step[1]) != 0)) + 1
        parts = [part(x, y) for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True)]
        n = np.concatenate([k for k, _ in parts])
        return {
            "n_common": pa.array(n.astype(np.int32)), "n_terms": pa.array((sizes[a] + sizes[b] - n).astype(np.int32)),
            "first": pa.array([t for _, texts in parts for t in texts], pa.string()), "same_owner": pa.array(owners[a] == owners[b]),
        }

    return of


def judged_cosine(vectors: DataFrame, modules: DataFrame, low: float = 0.40, threshold: float = THRESHOLD, digits: int = 6, block: int | None = None) -> DataFrame:
    """What judged says of all pairs of (id, vector) with a cosine of at least `low`, rounded to digits, with modules (module_id, summary, owner):
    (a, b, similarity, confirmed, confidence, play, reason).

    A module's terms are made once, and go with its vector to where blocks meet in cosine_pairs. So no pair carries a summary
    or terms through a join: what is shuffled does not depend on how many pairs there are."""
    n, least, last = vectors.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    # a module beyond the vectors' ids is in no pair; the summaries are dealt out by the join, and terms made after it
    told = modules.filter(F.col("module_id").between(F.lit(least), F.lit(last))).select(F.col("module_id").alias("id"), "summary", "owner")
    terms = F.array_join(F.transform(domain_tokens(F.coalesce("summary", F.col("id").cast("string"))), lambda t: F.concat(t, F.lit(" "))), "")
    rows = vectors.select("id", "vector").join(told, "id", "left").select("id", "vector", _packed(terms).alias("terms"), F.coalesce("owner", F.lit("unknown")).alias("owner"))
    pairs = cosine_pairs(rows, low, block, told=shared_terms, says="n_common int, n_terms int, first string, same_owner boolean", carried=("terms", "owner"), n=n)
    pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    said = verdict(F.col("similarity"), F.col("n_common"), F.col("n_terms"), F.col("first"), F.col("same_owner"), threshold)
    return pairs.withColumns(said).select("a", "b", "similarity", *said)


def judged_spans(vectors: DataFrame, low: float, med: float, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """What judged confirms of all pairs of (id, vector, summary, project_id) in two projects with a cosine of at least `low`, without a row for
    each pair: rows (a, b, tier), and rows (a, null b, n_candidates, n_confirmed) to be summed, of how many pairs each id is in.

    Blocks meet as in cosine_pairs, and a task judges all pairs of its two blocks. Of the confirmed ones it gives those that hold their
    components together, at most one for each id, and for a component that has pairs of tier LOW one of these. So the components of all rows, and
    their weakest tiers, are those of all confirmed pairs. The work is quadratic, as that of cosine_pairs is; rows and memory are not."""
    n = vectors.count()
    block = block or min(32768, max(2048, math.ceil(n / 8)))
    blocks = max(1, math.ceil(n / block))
    rows = vectors.select("id", "vector", "project_id", F.array_join(domain_tokens(F.coalesce("summary", F.col("id").cast("string"))), " ").alias("terms"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    side = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "vector", "project_id", "terms", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def met(key, pdf):
        import numpy as np
        import pandas as pd

        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        x /= np.where(norm > 0, norm, 1)[:, None]
        ids, at = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        group, said = pd.factorize(pdf["project_id"])[0], pdf["terms"]
        codes, sets = pd.factorize(said)
        sets = [t.split() for t in sets]
        holders: dict = {}
        for i, terms in enumerate(sets):
            for t in terms:
                holders.setdefault(t, []).append(i)
        holders = {t: np.array(held) for t, held in holders.items()}
        left, right = np.flatnonzero(at == key[0]), np.flatnonzero(at == key[1])
        left = left[np.argsort(codes[left], kind="stable")]  # what terms share is counted once for equal ones
        root, has_low = np.arange(len(ids)), np.zeros(len(ids), bool)
        seen, agreed = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        out, of = [], None
        for start in range(0, len(left), 256):
            some = left[start : start + 256]
            sims = x[some] @ x[right].T
            near = (sims >= low) & (group[some][:, None] != group[right])
            if key[0] == key[1]:
                near &= some[:, None] < right  # each pair once
            seen[some] += near.sum(1)
            seen[right] += near.sum(0)
            for i, cosine, candidates in zip(some, sims, near, strict=True):
                if codes[i] != of:
                    of = codes[i]
                    shared = np.bincount(np.concatenate([holders[t] for t in sets[of]]), minlength=len(sets)) if sets[of] else np.zeros(len(sets), int)
                    one, two = (shared >= 1)[codes[right]], (shared >= 2)[codes[right]]
                confirmed = candidates & (two | (one & (cosine >= threshold)))
                agreed[i] += confirmed.sum()
                agreed[right] += confirmed
                new = np.flatnonzero(confirmed & (root[right] != root[i]))
                if len(new):
                    others, first = np.unique(root[right[new]], return_index=True)
                    has_low[root[i]] |= has_low[others].any() or (cosine[new[first]] < med).any()
                    out += [(i, right[j], cosine[j] < med) for j in new[first]]
                    root[np.isin(root, others)] = root[i]
                if not has_low[root[i]]:
                    weak = np.flatnonzero(confirmed & (cosine < med))
                    if len(weak):
                        has_low[root[i]] = True
                        out.append((i, right[weak[0]], True))
        pairs = pd.DataFrame({"a": [min(ids[i], ids[j]) for i, j, _ in out], "b": [max(ids[i], ids[j]) for i, j, _ in out], "tier": ["LOW" if weak else "MED" for _, _, weak in out]}, dtype=object)
        held = np.flatnonzero(seen)
        return pd.concat([pairs, pd.DataFrame({"a": ids[held], "n_candidates": seen[held], "n_confirmed": agreed[held]})]).reindex(columns=["a", "b", "tier", "n_candidates", "n_confirmed"]).astype({"n_candidates": "Int64", "n_confirmed": "Int64"})

    kind = vectors.schema["id"].dataType.simpleString()
    return side.groupBy("p", "q").applyInPandas(met, f"a {kind}, b {kind}, tier string, n_candidates long, n_confirmed long")


def with_shared_resources(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds shared_resources: what both sides touch, as type:id strings."""
    touch = facts.select("module_id", F.concat_ws(":", "resource_type", "resource_id").alias("r")).distinct()
    pairs = candidates.select("a", "b").distinct()
    one, two = touch.withColumnsRenamed({"module_id": "a"}), touch.withColumnsRenamed({"module_id": "b"})
    both = pairs.join(one, "a").join(two, ["b", "r"]).groupBy("a", "b").agg(F.array_sort(F.collect_list("r")).alias("shared_resources"))
    return candidates.join(both, ["a", "b"], "left").withColumn("shared_resources", F.coalesce("shared_resources", F.array().cast("array<string>")))


def retry_after(headers: dict[str, str], attempt: int, most: float = 60.0) -> float:
    """Seconds to wait before another attempt: what the server says, or else a doubling time."""
    said = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
    try:
        return max(0.0, min(most, float(said)))
    except ValueError:
        return min(most, 2.0**attempt)


def auth_headers(key: str | None, extra: dict[str, str] | None = None) -> dict[str, str]:
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}) | (extra or {})


def preflight(ask: Callable[[str], tuple[int, dict[str, str], str]]) -> tuple[bool, str]:
    """Whether a model answers at all, and what to look at if it does not."""
    try:
        status, _, body = ask('Answer with {"confirmed": true}')
    except Exception as e:  # noqa: BLE001  whatever stops the call is the answer
        return False, f"no connection: {e}"
    hints = {401: "the key is missing or wrong", 403: "the key may not use this model", 404: "the address or the model's name is wrong", 429: "too many requests; wait and try again"}
    if status != 200:
        return False, f"status {status}: {hints.get(status, 'the server failed')}"
    return ("{" in body), "ready" if "{" in body else "the answer has no JSON object"


@dataclass(frozen=True)
class Client:
    """A model behind an address that takes {model, messages, max_tokens} and answers with choices; it is sent to the
    executors, so it holds no connection."""

    address: str
    model: str
    key: str | None = None
    timeout: float = 60.0
    most_tokens: int = 600

    def __call__(self, prompt: str) -> tuple[int, dict[str, str], str]:
        """(status, headers, the answer's text)."""
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.most_tokens}
        try:
            with urlopen(Request(self.address, json.dumps(body).encode(), auth_headers(self.key)), timeout=self.timeout) as r:  # noqa: S310
                text = r.read().decode()
                return r.status, dict(r.headers), json.loads(text)["choices"][0]["message"]["content"]
        except HTTPError as e:
            return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


def prompt_of(row: dict) -> str:
    task = "Do these two software modules do the same job? Answer with a JSON object: confirmed, confidence, play (RETIRE, STANDARDIZE or LEAVE), reason."
    shared = row.get("shared_resources")
    return json.dumps({"task": task, "a": row["summary_a"], "b": row["summary_b"], "similarity": row["similarity"], "shared_resources": [] if shared is None else [*shared]})


def sound(found: object) -> bool:
    """Whether a model's answer is a verdict: what it gives must be of the kind, and in the vocabulary, that a judgement has."""
    if not isinstance(found, dict) or not isinstance(found.get("confirmed"), bool):
        return False
    confidence, play, reason = found.get("confidence", 0.0), found.get("play", PLAYS[0]), found.get("reason", "")
    number = isinstance(confidence, int | float) and not isinstance(confidence, bool)
    return number and 0 <= confidence <= 1 and isinstance(play, str) and play in PLAYS and isinstance(reason, str)


def answered(prompt: str, ask: Callable[[str], tuple[int, dict[str, str], str]], attempts: int) -> dict | None:
    """The verdict of a model's answer, or None if it is none; a busy server is asked again."""
    for attempt in range(attempts):
        try:
            status, headers, body = ask(prompt)
        except Exception:  # noqa: BLE001  a model that cannot be reached is not an error of the data
            return None
        if status == 429:
            time.sleep(retry_after(headers, attempt))
            continue
        if status != 200:
            return None
        try:
            found = json.loads(body[body.find("{") : body.rfind("}") + 1])
        except ValueError:
            return None
        return found if sound(found) else None
    return None


def asked(judgements: DataFrame, ask: Callable[[str], tuple[int, dict[str, str], str]], attempts: int = 3, pause: float = 0.0, at_once: int = 4) -> DataFrame:
    """judged rows asked again of a model, `at_once` at a time in each task. ask(prompt) gives (status, headers, body),
    and is sent to the executors; where it fails, the heuristic verdict stays and its reason says so."""
    names = ("confirmed", "confidence", "play", "reason")

    def batches(it):
        def one(row):
            answer = answered(prompt_of(row), ask, attempts)
            if pause:
                time.sleep(pause)
            return answer

        for pdf in it:
            with ThreadPoolExecutor(at_once) as pool:
                answers = [*pool.map(one, pdf.to_dict("records"))]
            for i, answer in zip(pdf.index, answers, strict=True):
                if answer is None:
                    pdf.at[i, "reason"] = f"[Fallback: no answer] {pdf.at[i, 'reason']}"
                    continue
                for n in names:
                    if n in answer:
                        pdf.at[i, n] = float(answer[n]) if n == "confidence" else answer[n]
            yield pdf

    return judgements.mapInPandas(batches, judgements.schema)


def by_model(ask: Callable[[str], tuple[int, dict[str, str], str]], **options) -> Callable:
    """A judge for a run's configuration: the heuristic's verdicts, asked again of a model."""
    return lambda candidates, summaries, owners, threshold=THRESHOLD: asked(judged(candidates, summaries, owners, threshold), ask, **options)
