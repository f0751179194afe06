"""Quality by co-training: two views of a document teach each other.

The content view sees the text's bytes and nothing else; the metadata view sees language, source and
length and never the text. Each is a logistic regression. In each round both score all unlabelled
documents; of what one is sure of some joins, with that label, the other's training set. The views are calibrated on
labelled documents that neither was trained on, and a logistic regression over the two calibrated logits
gives the score of every document.

Only what a fit reads is bounded: at most `labelled` labelled documents, those with the smallest hash of doc_id,
and a share of `pool` pseudo-labelled ones a round, out of all documents that the view is sure of: first the surest
of each source and language, for half of the places, then the surest. The features of all documents are written
once; a round reads them and scores them on the executors, and the driver gets a vector of FEATURES numbers for
each document that a fit reads. Scoring at the end is one pass over whole texts without a shuffle."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable, forget, fresh

PAIRS, SHAPES, META = 256, 9, 128
FEATURES = PAIRS + SHAPES
LABELLED, POOL, ROUNDS, SEED = 4000, 4000, 5, 11
#: How sure a view must be, and how many documents each round hands over at most, as a share of POOL, by label in proportion.
SURE, SHARE = 0.95, 0.05
THRESHOLD = 0.5


def content(text: str | None):
    """The content view. First the square roots of the shares of the text's byte pairs, folded to PAIRS
    places; then SHAPES shares between 0 and 1: words like the one before, words seen before, capitals,
    digits, symbols, doubled marks, bytes beyond ASCII, white space, repeated lines. What short texts say
    is held back: a share is of the count and some more, so little text gives little evidence."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    raw, words, lines = np.frombuffer(data, np.uint8), data.split(), [x for x in data.split(b"\n") if x.strip()]
    out = np.zeros(FEATURES, np.float32)
    if len(raw) < 2:
        return out
    pairs = (raw[:-1].astype(np.uint16) * 37 + raw[1:]) % PAIRS
    out[:PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / (len(pairs) + 100))
    kinds = np.bincount(raw, minlength=256)
    marks = (raw >= 33) & (raw <= 47)
    n, k = len(raw) + 50, len(words) + 10
    out[PAIRS:] = (
        sum(map(bytes.__eq__, words[1:], words)) / k, (len(words) - len(set(words))) / (2 * k), kinds[65:91].sum() / n, kinds[48:58].sum() / n, (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        np.count_nonzero((raw[1:] == raw[:-1]) & marks[1:]) / n, kinds[128:].sum() / n, (kinds[9:14].sum() + kinds[32]) / n, (len(lines) - len(set(lines))) / (len(lines) + 3),
    )
    return out


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """The metadata view: the places, out of META, that are one. Null is a value like others."""
    length = -1 if n_chars is None else max(0, int(n_chars)).bit_length()
    return [zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % META for kind, value in (("lang", lang), ("source", source), ("length", length))]


@dataclass
class Logistic:
    """Weights, the last one for the constant; a label share that is all one or all zero gives a constant."""

    weights: list = field(default_factory=list)

    def fit(self, x, y, weight=None, penalty: float = 0.02, steps: int = 300) -> Logistic:
        """Accelerated gradient steps of the bound's length: the same result for the same rows."""
        import numpy as np

        x = np.hstack([np.asarray(x, np.float32), np.ones((len(x), 1), np.float32)])
        y = np.asarray(y, np.float64)
        weight = np.ones(len(y)) if weight is None else weight
        w = np.zeros(x.shape[1])
        share = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3)
        w[-1] = np.log(share / (1 - share))
        if 0 < y.mean() < 1:
            ridge = np.full(len(w), penalty)
            ridge[-1] = 1e-6
            v = np.ones(x.shape[1])
            for _ in range(20):
                v = x.T @ (weight * (x @ v))
                v /= np.linalg.norm(v)
            rate = 1 / (0.25 * (v @ (x.T @ (weight * (x @ v)))) * 1.05 + penalty)
            ahead = w
            for k in range(steps):
                slope = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ ahead, -35, 35))) - y)) + ridge * (ahead - np.where(np.arange(len(w)) < len(w) - 1, 0, ahead))
                new = ahead - rate * slope
                ahead, w = new + k / (k + 3) * (new - w), new
        self.weights = w
        return self

    def logit(self, x):
        import numpy as np

        return np.clip(np.asarray(x, np.float64) @ self.weights[:-1] + self.weights[-1], -35, 35)


@dataclass
class Model:
    """None of the views if there was nothing to learn from: then every document has the constant score."""

    constant: float = 1.0
    text: Logistic | None = None
    meta: Logistic | None = None
    text_scale: Logistic | None = None
    meta_scale: Logistic | None = None
    joint: Logistic | None = None
    handed: list = field(default_factory=list)  # pseudo-labels per round: (to metadata, to content)

    def score(self, x_text, x_meta):
        """(content view, metadata view, score), each calibrated, for the rows of two matrices."""
        import numpy as np

        if self.joint is None:
            same = np.full(len(x_text), self.constant)
            return same, same, same
        one = lambda z: 1 / (1 + np.exp(-z))
        a = self.text_scale.logit(self.text.logit(x_text)[:, None])
        b = self.meta_scale.logit(self.meta.logit(x_meta)[:, None])
        return one(a), one(b), one(self.joint.logit(np.column_stack([a, b])))


def wide(places: list[list[int]]):
    import numpy as np

    out = np.zeros((len(places), META), np.float32)
    for i, p in enumerate(places):
        out[i, p] = 1
    return out


def teach(x_text, x_meta, y, pick, rounds: int = ROUNDS) -> Model:
    """Co-training on labelled rows (y 0 or 1); every fourth labelled row is kept for calibration.

    pick(models, share of ones) gives for each view what it is sure of, as (content, metadata, labels) of rows that
    were not picked before."""
    import numpy as np

    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 1.0)
    late = np.arange(len(y)) % 4 == 3
    if len(set(y[late])) < 2 or len(set(y[~late])) < 2:
        late = np.zeros(len(y), bool)
    held = late if late.any() else np.ones(len(y), bool)
    taught = {"text": [(x_text[~late], y[~late])], "meta": [(x_meta[~late], y[~late])]}
    share, handed = y.mean(), []

    def fitted(kind):
        x, t = (np.concatenate(c) for c in zip(*taught[kind], strict=True))
        return Logistic().fit(x, t)

    for _ in range(rounds):
        given = pick({k: fitted(k) for k in taught}, share)
        for kind, (of_text, of_meta, labels) in given.items():
            if len(labels):
                taught["meta" if kind == "text" else "text"].append((of_meta if kind == "text" else of_text, np.asarray(labels, np.float64)))
        handed.append((len(given["text"][2]), len(given["meta"][2])))
        if not any(handed[-1]):
            break
    text, meta = fitted("text"), fitted("meta")
    a, b = text.logit(x_text[held])[:, None], meta.logit(x_meta[held])[:, None]
    text_scale, meta_scale = (Logistic().fit(z, y[held], penalty=1e-3, steps=2000) for z in (a, b))
    both = np.column_stack([text_scale.logit(a), meta_scale.logit(b)])
    return Model(float(share), text, meta, text_scale, meta_scale, Logistic().fit(both, y[held], penalty=1e-3, steps=2000), handed)


def places(size: int, share: float) -> list[tuple[int, int]]:
    """(label, how many rows of it a view hands over at most in a round)."""
    return [(label, max(1, int(size * SHARE * part))) for label, part in ((1, share), (0, 1 - share))]


def train(x_text, x_meta, y, pool_text, pool_meta, rounds: int = ROUNDS) -> Model:
    """teach with unlabelled rows that are all in memory."""
    import numpy as np

    views, free = {"text": pool_text, "meta": pool_meta}, np.ones(len(pool_text), bool)

    def pick(models, share):
        picks: dict[str, list[tuple[int, int]]] = {}
        for kind, model in models.items():
            p = 1 / (1 + np.exp(-model.logit(views[kind])))
            picks[kind] = []
            for label, most in places(len(p), share):
                sure = p if label else 1 - p
                ranked = np.argsort(-sure, kind="stable")
                picks[kind] += [(i, label) for i in ranked[free[ranked] & (sure[ranked] >= SURE)][:most]]
        out = {}
        for kind, found in picks.items():
            rows = np.array([i for i, _ in found], int)
            free[rows] = False
            out[kind] = (pool_text[rows], pool_meta[rows], [v for _, v in found])
        return out

    return teach(x_text, x_meta, y, pick, rounds)


def _content_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def of(texts):
        import numpy as np
        import pyarrow as pa

        out = np.zeros((len(texts), FEATURES), np.float32)
        for i, t in enumerate(texts):
            out[i] = content(t.as_py())
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, FEATURES, dtype=np.int32), out.ravel())

    return of(text)


def _sure(models: dict[str, Logistic]) -> Column:
    """A struct (text, meta): what each view by itself says of a row of features."""

    @F.arrow_udf("text double, meta double")
    def of(x, langs, sources, lengths):
        import numpy as np
        import pyarrow as pa

        rows = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, FEATURES)
        meta = wide([metadata(*r) for r in zip(langs.to_pylist(), sources.to_pylist(), lengths.to_pylist(), strict=True)])
        parts = (1 / (1 + np.exp(-models[kind].logit(v))) for kind, v in (("text", rows), ("meta", meta)))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()) for p in parts], names=["text", "meta"])

    return of("x", "lang", "source", "n_chars")


def _picked(said: DataFrame, size: int, share: float, seed: int) -> dict[str, dict[int, int]]:
    """{view: {doc_id: label}} out of said (doc_id, source, lang, text, meta), the documents not yet handed over.

    Ranks are cut where the rows lie: a task hands on no more rows of a view and label than there are places."""
    most = dict(places(size, share))
    sure = [F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), (F.col(kind) if label else 1 - F.col(kind)).alias("sure")) for kind in ("text", "meta") for label in most]
    rows = said.select("doc_id", "source", "lang", F.inline(F.array(*sure))).filter(F.col("sure") >= SURE)
    rows = rows.select("kind", "label", "source", "lang", F.struct("sure", F.xxhash64(F.lit(seed), "doc_id").alias("hash"), "doc_id").alias("d"))
    heads = rows.groupBy("kind", "label", "source", "lang").agg(F.max("d").alias("d"))
    surest = Window.partitionBy("kind", "label").orderBy(F.desc("d"))

    def top(df: DataFrame, first: bool, n: int) -> DataFrame:
        ranked = df.select("kind", "label", "d", F.row_number().over(surest).alias("nth")).filter(F.col("nth") <= n)
        return ranked.select("kind", "label", F.lit(first).alias("first"), "d", "nth")

    both = top(heads, True, (max(most.values()) + 1) // 2).unionByName(top(rows, False, max(most.values())))
    found = [r for r in both.collect() if r["nth"] <= ((most[r["label"]] + 1) // 2 if r["first"] else most[r["label"]])]
    found.sort(key=lambda r: (not r["first"], -r["d"]["sure"], -r["d"]["hash"]))
    out: dict[str, dict[int, int]] = {"text": {}, "meta": {}}
    for kind in out:
        for label, n in most.items():
            ids = [*dict.fromkeys(r["d"]["doc_id"] for r in found if (r["kind"], r["label"]) == (kind, label))]
            out[kind] |= dict.fromkeys(ids[:n], label)
    return out


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Fits the model for labels (doc_id, quality). A document with several labels has the lowest; rows
    without id or label are passed over. Of rows with one doc_id, that with the smallest hash of its text counts."""
    import numpy as np

    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    features = durable(
        docs.filter("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
            _content_column(F.col("text")).alias("x"),
        )
    )
    hashed = F.xxhash64(F.lit(seed), "doc_id")

    def rows_of(ids: DataFrame):
        """doc_ids, qualities, content and metadata of few documents, by hash."""
        one = features.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("h", "lang", "source", "n_chars", "x")).alias("d"))
        got = one.select("doc_id", "quality", "d.*").orderBy(hashed, "doc_id").toArrow()
        x = np.array(got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, FEATURES)
        meta = wide([metadata(*m) for m in zip(*(got.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])
        return got.column("doc_id").to_pylist(), got.column("quality").to_pylist(), x, meta

    drawn = known.join(features.select("doc_id"), "doc_id", "left_semi").orderBy(hashed, "doc_id").limit(labelled)
    _, quality, x, meta = rows_of(drawn)
    handed: set[int] = set()

    def pick(models, share):
        row = F.min(F.struct("h", "source", "lang", "n_chars", "p")).alias("d")
        said = features.select("doc_id", "h", "source", "lang", "n_chars", _sure(models).alias("p")).groupBy("doc_id").agg(row).join(known.select("doc_id"), "doc_id", "left_anti")
        sure = durable(said.select("doc_id", "d.source", "d.lang", "d.p.text", "d.p.meta").filter(F.greatest("text", "meta", 1 - F.col("text"), 1 - F.col("meta")) >= SURE))
        said = sure
        if handed:
            said = said.join(spark.createDataFrame([(d,) for d in sorted(handed)], "doc_id long").hint("broadcast"), "doc_id", "left_anti")
        picks = _picked(said, pool, share, seed)
        forget(sure)
        new = {d for found in picks.values() for d in found}
        handed.update(new)
        ids, _, of_text, of_meta = rows_of(spark.createDataFrame([(d, None) for d in sorted(new)], "doc_id long, quality int"))
        at = {kind: [i for i, d in enumerate(ids) if d in found] for kind, found in picks.items()}
        return {kind: (of_text[i], of_meta[i], [picks[kind][ids[k]] for k in i]) for kind, i in at.items()}

    model = teach(x, meta, [float(q > 0) for q in quality], pick, rounds)
    forget(features)
    return model


def scored(model: Model, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """A struct (p_text, p_meta, score)."""

    @F.arrow_udf("p_text double, p_meta double, score double")
    def of(texts, langs, sources, lengths):
        import numpy as np
        import pyarrow as pa

        parts = [], [], []
        rows = [*zip(langs.to_pylist(), sources.to_pylist(), lengths.to_pylist(), strict=True)]
        for at in range(0, len(texts), 512):
            x = np.array([content(t.as_py()) for t in texts[at : at + 512]])
            for part, p in zip(parts, model.score(x, wide([metadata(*r) for r in rows[at : at + 512]])), strict=True):
                part.append(p)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(p) if p else [], pa.float64()) for p in parts], names=["p_text", "p_meta", "score"])

    return of(text, lang.cast("string"), source.cast("string"), n_chars.cast("long"))


def _score(model: Model) -> Column:
    return scored(model, *(F.col(c) for c in ("text", "lang", "source", "n_chars")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row of docs; kept: score at or over the threshold.

    A null text is an empty one, null metadata a value like others. Null and repeated doc_ids are rows like
    others. Without labels of both kinds nothing can be learnt, and the score is the only label's value, or
    1 without labels. An empty table gives no rows; other columns are not read. A text of any length is read whole."""
    model = learn(docs, labels, **options)
    rows = docs.select("doc_id", _score(model).alias("s"))
    return rows.select("doc_id", "s.*", (F.col("s.score") >= threshold).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that quality keeps, columns as they are. Equal rows have one score, so all or none of them stay;
    an empty table gives no rows."""
    score = fresh(docs, "_score")
    model = learn(docs, labels, **options)
    return docs.withColumn(score, _score(model)["score"]).filter(F.col(score) >= threshold).drop(score)
