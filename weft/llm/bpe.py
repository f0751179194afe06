"""Byte-level BPE: encoding by ranked merges in Spark's higher-order functions, decoding by concatenation.

A vocabulary maps byte strings to ranks. A word starts as its bytes; the adjacent pair whose joint bytes
have the least rank is merged, leftmost first, until no pair is in the vocabulary. Here a piece is its id
(the id is the rank), so the merge table maps pairs of ids to ids. It is a literal in the plan: each left id has a
row of its right ids, and all rows lie in one array, moved on until none meet, so that a lookup is two array reads
whatever the size of the vocabulary.

The words of the whole corpus are counted, and each frequent word is folded once, on the executors. The
most frequent (at most DICTIONARY words of at most WIDEST characters, so the broadcast has a bound in bytes) serve as
a dictionary with which the texts are encoded. A word that is not among them is folded by the same expression in its
document's row, once for each document, so every id of the result comes from the fold, and no row is dropped or
shuffled but the word counts.

A fold's time grows with the square of the word. So a word of over 2 * STRETCH characters is folded in windows of two
stretches each, half of which the next one shares, and these are joined at a token that both have: a sequence of
tokens is what the merges give if each two neighbours are (by what is said in merge_pairs, nothing crosses their
ends before they would merge), and every two neighbours of the joined sequence stand together in one window. Windows
without a common token (long runs of one character) are rare; such a word is merged with a heap when it is put together."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import durable, forget, let

#: Most words in the broadcast dictionary, and most characters of one: some 30 MB for words of usual length.
DICTIONARY, WIDEST = 524_288, 64
#: Of these the FREQUENT first are in a dict, some 15 MB; the rest in flat tables, looked up many at once.
FREQUENT = 65_536
#: Characters of half a window.
STRETCH = 48
_NEVER = 2**31 - 1
#: Bits of an id in the fold's numbers; an id that no vocabulary has marks a missing word.
_BITS = 20
_MISSING = 2**32 - 1
_MARK = _MISSING.to_bytes(4, "little")


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary in a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_pairs(ranks: dict[bytes, int]) -> tuple[dict[tuple[int, int], int], dict[bytes, int]]:
    """The pairs of ids that can ever merge, with what they merge to; and the tokens that merging never gives.

    Many pairs of tokens join to a token, but each token has only one last merge. While two pieces stand
    side by side, what happened between their ends is what would happen to those bytes alone, and alone the
    bytes of a token go through just one state of two pieces. So its pair is the only one worth keeping."""
    pairs, apart = {}, {}
    for token, rank in ranks.items():
        if len(token) > 1:
            last = [token[i : i + 1] for i in range(len(token))]
            while len(last) > 2:
                least, i = min((ranks.get(x + y, _NEVER), i) for i, (x, y) in enumerate(zip(last, last[1:], strict=False)))
                if least == _NEVER:
                    break
                last[i : i + 2] = [last[i] + last[i + 1]]
            if len(last) == 2:
                pairs[ranks[last[0]], ranks[last[1]]] = rank
            else:
                apart[token] = rank
    return pairs, apart


def merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ranked merges of one word in plain Python, to test by."""
    ids = [*ids]
    while len(ids) > 1:
        rank, i = min((pairs.get((a, b), _NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
        if rank == _NEVER:
            break
        ids[i : i + 2] = [rank]
    return ids


def heap_merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """merged for words of any length: pieces are linked, and a heap has the pairs by rank and place."""
    n = len(ids)
    ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:  # one of them has gone meanwhile
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pairs.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, rank, ids[after[i]]))
        if before[i] >= 0 and (r := pairs.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
    return [x for x in ids if x >= 0]


def spliced(windows: list[tuple[int, list[int]]], widths: list[int]) -> list[int] | None:
    """The tokens of a word from those of its windows (the byte where one starts, its ids), each of which shares bytes
    with the next; None if two neighbours have no token in common. widths: bytes of each id."""
    out: list[int] = []
    ends: list[int] = []  # where each of them ends
    for start, ids in windows:
        at, spans = start, []
        for i in ids:
            spans.append((at, at + widths[i]))
            at += widths[i]
        if not out:
            cut = 0
        else:
            low = len(ends)
            while low and ends[low - 1] > start:
                low -= 1
            held = {(ends[k] - widths[out[k]], ends[k]): k for k in range(low, len(out))}
            cut = next((k for k, x in enumerate(spans) if x in held), None)
            if cut is None:
                return None
            keep = held[spans[cut]]
            del out[keep:], ends[keep:]
        out += ids[cut:]
        ends += [e for _, e in spans[cut:]]
    return out


class Merges:
    """A vocabulary's merge table as literals, and the fold over them. Ids must be below 2^20 - 1."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        #: In the fold an id is one more than its rank; this one merges with nothing.
        self._edge = max(ranks.values()) + 2
        if self._edge >= 1 << _BITS:
            raise ValueError(f"ids of more than {_BITS} bits")
        self.pairs, self._whole = merge_pairs(ranks)
        rows: dict[int, list[int]] = {}
        for a, b in self.pairs:
            rows.setdefault(a + 1, []).append(b + 1)
        # the fullest rows first, each moved on to the first place where all of its ids are free
        taken, moved = 0, [0] * (self._edge + 1)
        for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
            clash = 0
            for b in rows[a]:
                clash |= taken >> b
            by = (~clash & (clash + 1)).bit_length() - 1
            moved[a] = by
            for b in rows[a]:
                taken |= 1 << (by + b)
        slots = [0] * (max(moved) + self._edge + 1)
        for (a, b), rank in self.pairs.items():
            slots[moved[a + 1] + b + 1] = (a + 1) << _BITS | (rank + 1)
        literal = lambda x: F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>")
        self._tables = F.struct(literal(slots).alias("slots"), literal(moved).alias("moved"))
        self._bytes = F.array(*[F.lit(ranks[bytes([b])] + 1) for b in range(256)]).cast("array<bigint>")

    @staticmethod
    def _piece(tables: Column, left: Column, right: Column) -> Column:
        """A piece with what it and the one on its right merge to: that id above its own id; a number of 2^40 or more
        if they do not. A slot has the left id above the merged one, so another's slot leaves high bits."""
        return F.shiftleft(tables["slots"][tables["moved"][left] + right].bitwiseXOR(F.shiftleft(left, _BITS)), _BITS).bitwiseOR(left)

    def fold(self, word: Column) -> Column:
        """The ids of a word, an array of int; empty and null words give none.

        The state is an array of pieces (see _piece) between two that merge with nothing; so a merge has neighbours on
        both sides wherever it is, and the least number is the pair to merge next."""
        raw = F.encode(word, "UTF-8")
        n = F.octet_length(word)
        rest, own = F.lit(2**30), lambda piece: piece.bitwiseAND((1 << _BITS) - 1)
        edge = F.array(F.lit(self._edge).cast("long"))
        none = F.array(F.lit(1 << 62 | self._edge).cast("long"))
        # as Latin-1 a byte is a character, and the character's code is the byte
        each = F.transform(F.split(F.decode(raw, "ISO-8859-1"), "", -1), lambda c: self._bytes[F.ascii(c)])

        def step(tables, pieces):
            def merge(least):
                def at(i):  # the pair's place, from 1
                    new = F.shiftright(least, _BITS)
                    sides = F.array(F.struct(own(pieces[i - 2]).alias("l"), new.alias("r")), F.struct(new.alias("l"), own(pieces[i + 1]).alias("r")))
                    return F.concat(F.slice(pieces, F.lit(1), i - 2), F.transform(sides, lambda p: self._piece(tables, p["l"], p["r"])), F.slice(pieces, i + 2, rest))

                return F.when(least >= 1 << 2 * _BITS, pieces).otherwise(let(F.array_position(pieces, least).cast("int"), at))

            return let(F.array_min(pieces), merge)

        def folded(tables, ids):
            pieces = F.concat(F.transform(F.sequence(F.lit(0), n), lambda i: self._piece(tables, ids[i], ids[i + 1])), none)
            last = F.aggregate(F.sequence(F.lit(1), n - 1), pieces, lambda pieces, _: step(tables, pieces))
            return let(last, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: (own(x) - 1).cast("int")))

        out = F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<int>")).when(n == 1, F.transform(each, lambda x: (x - 1).cast("int")))
        for token, rank in self._whole.items():  # a whole word that is a token is that token
            out = out.when(raw == F.lit(token), F.array(F.lit(rank)))
        # the tables are in the plan, and in its text, as often as they are named: once
        return out.otherwise(let(self._tables, lambda tables: let(F.concat(edge, each, edge), lambda ids: folded(tables, ids))))


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(load_ranks(path))


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n): how often each match of the pattern that may be in the dictionary occurs in the texts."""
    # Java's \s is ASCII only
    unicode = pattern.replace(r"[^\s", r"[^\s\p{IsWhite_Space}").replace(r"\s+", r"\p{IsWhite_Space}+")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(unicode), F.lit(0))).alias("word")).filter(F.length("word") <= WIDEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(docs: DataFrame, table: Merges, pattern: str, most: int = DICTIONARY) -> dict:
    """The most frequent words, at most `most`, with their ids as little-endian 32-bit numbers.

    Words with the count of the last one that fits stay out together, so the choice does not depend on
    how rows lie. The result's parts are flat bytes: words and ids one after another with their ends, the words' hashes
    in order with the words' numbers, and the numbers of the at most FREQUENT words that are most frequent."""
    from xxhash import xxh64_intdigest

    counts = durable(word_counts(docs, pattern))
    top = 1000
    by_count = dict(counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect())  # at most `top` rows

    def least(room: int) -> int:
        n = top + 1
        while n > 1 and by_count.get(n - 1, 0) <= room:
            n -= 1
            room -= by_count.get(n, 0)
        return n

    often = F.col("n") >= least(FREQUENT)
    chosen = counts.filter(F.col("n") >= least(most)).select(F.col("word").cast("binary").alias("word"), often.alias("often"), table.fold(F.col("word")).alias("ids")).toArrow()
    blobs, ends, codes, code_ends, frequent = [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], []
    for batch in chosen.to_batches(max_chunksize=65536):
        for column, data, stops, width in (("word", blobs, ends, 1), ("ids", codes, code_ends, 4)):
            x = batch[column]
            offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
            if column == "ids":
                data.append(x.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            else:
                data.append(bytes(memoryview(x.buffers()[2])[offsets[0] : offsets[-1]]) if len(x) else b"")
            stops.append((offsets[1:] - offsets[0]) * width + stops[-1][-1])
        frequent.append(batch["often"].to_numpy(zero_copy_only=False))
    blob, word_ends = b"".join(blobs), np.concatenate(ends).astype("<i4")
    del chosen, blobs
    forget(counts)
    pa.default_memory_pool().release_unused()  # the driver's memory is for more than this
    n = len(word_ends) - 1
    if not n:
        return {"n": 0}
    at, view, hashes = memoryview(word_ends), memoryview(blob), np.empty(n, np.uint64)
    for i in range(n):
        hashes[i] = xxh64_intdigest(view[at[i] : at[i + 1]])
    places = np.argsort(hashes, kind="stable").astype("<i4")
    numbers = np.flatnonzero(np.concatenate(frequent)).astype("<i4")
    return {
        "n": n, "words": blob, "word_ends": word_ends.tobytes(), "ids": b"".join(codes), "id_ends": np.concatenate(code_ends).astype("<i4").tobytes(),
        "hashes": hashes[places].tobytes(), "places": places.tobytes(), "often": numbers.tobytes(),
    }


def splitter(pattern: str):
    """A function from a text to the pattern's matches.

    Texts without characters from U+0250 on go through the standard library's faster engine, which has no
    Unicode categories: the classes are spelt out from the character database for just that range."""
    import re
    import unicodedata

    import regex

    whole = regex.compile(pattern).findall
    among = {"L": [], "N": []}
    for code in range(0x250):
        if (kind := unicodedata.category(chr(code))[0]) in among:
            among[kind].append(re.escape(chr(code)))
    space = re.escape("\t\n\v\f\r \x85\xa0")
    letters, numbers = "".join(among["L"]), "".join(among["N"])
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    try:
        latin = re.compile(spelt).findall
    except re.error:  # a pattern of another shape
        return whole
    beyond = re.compile("[\u0250-\U0010ffff]").search

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")  # the quickest of tests, and most texts pass it
        except UnicodeEncodeError as e:
            if beyond(text, e.start):
                return whole(text)
        return latin(text)

    return split


class Lookup(dict):
    """A worker's reading of the dictionary: text to ids, with the words that it lacks. As a dict it has the most
    frequent words."""

    def __init__(self, parts: dict, pattern: str):
        super().__init__()
        self.split = splitter(pattern)
        self.n = parts["n"]
        self.missing: list[str] = []
        if self.n:
            self.word_ends, self.places, codes, code_ends = (np.frombuffer(parts[k], "<i4") for k in ("word_ends", "places", "ids", "id_ends"))
            self.codes, self.code_ends = codes.view("<u4"), code_ends // 4
            self.words, self.hashes = np.frombuffer(parts["words"], np.uint8), np.frombuffer(parts["hashes"], np.uint64)
            for i in np.frombuffer(parts["often"], "<i4").tolist():
                self[parts["words"][self.word_ends[i] : self.word_ends[i + 1]].decode()] = parts["ids"][code_ends[i] : code_ends[i + 1]]

    def __missing__(self, word: str) -> bytes:
        self.missing.append(word)
        return _MARK

    def found(self, words: list[str]) -> np.ndarray:
        """Each word's number in the flat tables, or -1. (A word with the hash of one before it is not found; then it
        is folded like any that is not there.)"""
        from xxhash import xxh64_intdigest

        if not self.n or not words:
            return np.full(len(words), -1, np.int32)
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int32, len(raws))
        hashes = np.fromiter(map(xxh64_intdigest, raws), np.uint64, len(raws))
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        numbers = self.places[at]
        starts = self.word_ends[numbers]
        same = (self.hashes[at] == hashes) & (self.word_ends[numbers + 1] - starts == sizes) & (sizes > 0)
        if same.any():  # the bytes decide
            size = sizes[same]
            equal = self.words[_runs(starts[same], size)] == np.frombuffer(b"".join(raws), np.uint8)[_runs((np.cumsum(sizes) - sizes)[same], size)]
            same[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return np.where(same, numbers, -1)

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[str], list[int]]]:
        """For each text: ids as 32-bit numbers with a mark for each missing word; the distinct words and windows to
        fold; and what each mark stands for: a number of one, or, negative, how many windows, and their numbers and
        first bytes. What the dict lacks in all of the texts is looked up in the flat tables at once."""
        self.missing, parts, lacking = [], [], []
        for text in texts:
            parts.append(b"".join(map(self.__getitem__, self.split(text))))
            lacking.append(len(self.missing))
        words, self.missing = self.missing, []
        numbers = self.found(words)
        ids = np.frombuffer(b"".join(parts), "<u4")
        ends = np.cumsum([0, *map(len, parts)]) // 4
        del parts
        known = numbers >= 0
        if known.any():
            of = numbers[known]
            ids, first = _put(ids, np.flatnonzero(ids == _MISSING)[known], self.codes, self.code_ends[of], self.code_ends[of + 1] - self.code_ends[of])
            ends = first[ends]
        rare = np.flatnonzero(~known)
        bounds = np.searchsorted(rare, [0, *lacking]).tolist()
        rare = rare.tolist()
        return [(ids[a:b].tobytes(), *_marks(words[k] for k in rare[c:d])) for (a, b), (c, d) in zip(pairwise(ends.tolist()), pairwise(bounds), strict=True)]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _put(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with a run of codes in place of each one of the places `at`; and where each place begins in the result."""
    first = np.ones(len(ids) + 1, np.int32)
    first[0] = 0
    first[1:][at] = sizes
    np.cumsum(first, out=first)
    stay = np.ones(len(ids), bool)
    stay[at] = False
    out = np.empty(first[-1], "<u4")
    out[first[:-1][stay]] = ids[stay]
    out[_runs(first[at], sizes)] = codes[_runs(starts, sizes)]
    return out, first


def _marks(missing) -> tuple[list[str], list[int]]:
    """The distinct words and windows of a text's missing words, and what stands for each (see Lookup.encode)."""
    numbers: dict[str, int] = {}
    marks: list[int] = []
    for word in missing:
        if len(word) <= 2 * STRETCH:
            marks.append(numbers.setdefault(word, len(numbers)))
        else:
            starts = range(0, len(word) - STRETCH, STRETCH)
            marks.append(-len(starts))
            at = 0
            for i in starts:
                marks += (numbers.setdefault(word[i : i + 2 * STRETCH], len(numbers)), at)
                at += len(word[i : i + STRETCH].encode())
    return [*numbers], marks


def filled(batch: pa.RecordBatch, whole) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch's rows as unsigned 32-bit numbers, the marked places filled, and where each row's end.
    whole(windows): a long word's ids."""
    part, words, marks = batch["part"], batch["folds"], batch["marks"]
    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
    ids = np.frombuffer(part.buffers()[2], "<u4", int(ends[-1] - ends[0]) // 4, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, "<u4")
    rows = (ends - ends[0]) // 4
    at = np.flatnonzero(ids == _MISSING)
    if not len(at):
        return ids, rows
    row_marks, row_words = marks.offsets.to_numpy(), words.offsets.to_numpy()
    given = marks.values.to_numpy()[row_marks[0] : row_marks[-1]]
    codes, bounds = words.values.values.to_numpy(zero_copy_only=False), words.values.offsets.to_numpy()
    if (given >= 0).all():
        of = given + np.repeat(row_words[:-1], np.diff(row_marks))
        starts, sizes = bounds[of], bounds[of + 1] - bounds[of]
    else:
        starts, sizes, more, n = [], [], [codes], len(codes)
        given = given.tolist()
        for row in range(len(part)):
            base, m = int(row_words[row]), iter(given[row_marks[row] - row_marks[0] : row_marks[row + 1] - row_marks[0]])
            for k in m:
                if k >= 0:
                    starts.append(bounds[base + k])
                    sizes.append(bounds[base + k + 1] - bounds[base + k])
                else:
                    numbers = [(base + next(m), next(m)) for _ in range(-k)]
                    long = whole([(codes[bounds[i] : bounds[i + 1]].tolist(), first) for i, first in numbers])
                    starts.append(n)
                    sizes.append(len(long))
                    more.append(np.asarray(long, codes.dtype))
                    n += len(long)
        starts, sizes, codes = np.asarray(starts, np.int32), np.asarray(sizes, np.int32), np.concatenate(more)
    out, first = _put(ids, at, codes, starts, sizes)
    return out, first[rows]


def pieces_of(path: str) -> list[bytes | None]:
    """Each id's bytes."""
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, path: str, pattern: str, most: int = DICTIONARY, decoded: bool = False, written: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of docs: the text's ids as little-endian unsigned 32-bit numbers; with
    `decoded` also the bytes that these ids decode to, from the same pass. With `written` the rows between the two
    passes are written: a task then has one Python worker at a time, not two, for disk of some 1.5 x the input.

    A null text is an empty one, without ids. Null and repeated doc_ids are rows like others; an empty
    table gives no rows; other columns are not read. Texts and words may be of any length: the time is in proportion."""
    table = merges(path)
    context = docs.sparkSession.sparkContext
    known = context.broadcast(dictionary(docs, table, pattern, most))
    vocabulary = context.broadcast(pieces_of(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def partly(batches):
        lookup = Lookup(known.value, pattern)
        for batch in batches:
            for part in _small(batch):
                found = [x for texts in _stretches([t or "" for t in part["text"].to_pylist()]) for x in lookup.encode(texts)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)]
                del found
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=["doc_id", "part", "words", "marks"])
                del columns
            batch = part = None  # free before the next one is read
            pa.default_memory_pool().release_unused()

    def wholly(batches):
        pieces = vocabulary.value
        widths = [len(p or b"") for p in pieces]
        reading: list = []

        def whole(windows):
            ids = spliced([(at, ids) for ids, at in windows], widths)
            if ids is None:
                # the windows' bytes but for those that the one before has
                last, raw = 0, []
                for window, at in windows:
                    text = b"".join(map(pieces.__getitem__, window))
                    raw.append(text[last - at :])
                    last = at + len(text)
                if not reading:
                    ranks = {p: i for i, p in enumerate(pieces) if p is not None}
                    reading.extend(([ranks[bytes([b])] for b in range(256)], merge_pairs(ranks)[0]))
                ids = heap_merged([reading[0][b] for b in b"".join(raw)], reading[1])
            return ids

        for batch in batches:
            for part in _small(batch):
                ids, ends = filled(part, whole)
                columns = [part["doc_id"], pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])]
                if decoded:
                    columns.append(pa.array([b"".join(map(pieces.__getitem__, ids[a:b].tolist())) for a, b in pairwise(ends.tolist())], pa.binary()))
                del ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
                del columns
            batch = part = None
            pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", "text").mapInArrow(partly, f"doc_id {kind}, part binary, words array<string>, marks array<int>")
    if written:
        rows = durable(rows)
    rows = rows.select("doc_id", "part", F.transform("words", table.fold).alias("folds"), "marks")
    return rows.mapInArrow(wholly, f"doc_id {kind}, ids binary" + ", decoded binary" * decoded)


def _small(batch, rows: int = 256):
    """A batch in parts, so that what is made of it is never much at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _stretches(texts: list[str], most: int = 1 << 20):
    """Runs of texts of some `most` characters, a longer text by itself, so that their words are never many at once."""
    run, n = [], 0
    for text in texts:
        if run and n + len(text) > most:
            yield run
            run, n = [], 0
        run.append(text)
        n += len(text)
    if run:
        yield run


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids (as encode gives them) stand for. An id that the vocabulary lacks is an error."""
    pieces = pieces_of(path)

    @F.arrow_udf("binary")
    def of(values):
        return pa.array([b"".join(map(pieces.__getitem__, np.frombuffer(v.as_py() or b"", "<u4").tolist())) for v in values], pa.binary())

    return of(ids)
