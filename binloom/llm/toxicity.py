"""Toxicity by class-conditional Kneser-Ney models.

Two models, learned from toxic and from ordinary documents, spell out words: the first letters, then one more letter at
a time up to the longest of STEMS, then the rest of the word. With e the next piece and h the piece before it

    p_class(e | h) = max(count_class(e) - D(count_class(e)), 0) / count_class(h) + held_back_class(h) / count_class(h) * p_shared(e | h)

with modified Kneser-Ney discounts D of the class for counts of 1, 2, and 3 or more, and what they hold back under h. The
backoff is shared by both classes and made of continuation counts: the number of different words of either class that go
on from h with e, one kept for words never seen. So a rare inflection is judged by its stem, an unknown word by the longest
beginning that is known, and where a class has not seen h at all it says what both say together. A document counts a
word once.

A document's ordinary log-likelihood is that of its different words under the ordinary model. Its toxic one lets a share
`toxic_words` of the words come from the toxic model and the rest from the ordinary one, as toxic texts consist of
ordinary words for the most part. Both are divided by the number of words, and their difference becomes a probability by a
logistic curve. The curve is fitted on a part of the training documents (by a hash of the text), from which no count comes.

The counts are of all training documents but those, and no word is dropped. Where the model's rows are at most
`broadcast_rows`, each executor holds it whole (16 bytes a row); a larger one is joined to the documents' words by
shuffle, with the same result.

Defined results: null, empty and wordless texts have the difference 0; several labels of one document
count as toxic if one is; null labels and ids are left out of learning; without toxic or ordinary
documents to count every score is the share of toxic ones, 0 if there are none. Two imagined documents, one of each class,
keep the curve finite where few are left to fit it. Repeated rows count each and score alike; very long texts are taken apart
whole; an empty table of documents gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, slices, stored

STEMS = (2, 3, 4, 5)
#: Labels up to this many go to each executor whole (12 bytes a row); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Words whose values a task keeps at hand.
CACHED_WORDS = 500_000
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """The share of a toxic text's words that the toxic model gives; one of how many training documents fits the curve; rows of a model that go to each executor."""

    toxic_words: float = 0.01
    curve_part: int = 4
    broadcast_rows: int = 4_000_000


def distinct_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def expressions(word: str) -> list[str]:
    """A word, marked at its end, then its beginnings, the longest first, and nothing."""
    return [word + "$", *(word[:n] for n in reversed(STEMS) if len(word) > n), ""]


def _keys(found: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(e.encode("utf-8", "surrogatepass")) for e in found), np.uint64, len(found))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, ordinary documents) of each batch, summed over the batch before they leave."""
    for batch in batches:
        counts: tuple[dict[str, int], dict[str, int]] = {}, {}
        for few in slices([batch], 0):
            for text, label in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                own = counts[label]
                for w in distinct_words(text):
                    own[w] = own.get(w, 0) + 1
        words = list({**counts[0], **counts[1]})
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([own.get(w, 0) for w in words], pa.int64()) for own in (counts[1], counts[0])]], ["word", "t", "o"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how many words have each small count; each count has one more so that none is 0."""
    n1, n2, n3, n4 = n1 + 1, n2 + 1, n3 + 1, n4 + 1
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), j) for j, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def fit_model(train: DataFrame) -> DataFrame | None:
    """Of (text, toxic) rows: the stored table (expression, lt, lo). For a word both log probabilities, for a beginning (and "" for none) those of an
    unknown word that goes on from it. None if there are no toxic or no ordinary words."""
    spark = train.sparkSession
    counts = train.mapInArrow(_count, "word string, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    words = stored(spark, counts, "words")
    seen = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_all") for c in "to"], *[F.count_if(F.col(c) == j).alias(f"{c}_{j}") for c in "to" for j in range(1, 5)]).first()
    if not seen.t_all or not seen.o_all:
        dropped(words)
        return None
    cut = {c: discounts(*[seen[f"{c}_{j}"] for j in range(1, 5)]) for c in "to"}

    def off(c: str) -> Column:
        """What is taken off a count."""
        one, two, more = cut[c]
        return F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, one).when(F.col(c) == 2, two).otherwise(more)

    def begin(n: int) -> Column:
        return F.substring("word", 1, n)

    length = F.length("word")
    before = F.coalesce(*[F.when(length > n, begin(n)) for n in reversed(STEMS)], F.lit(""))
    pieces = [F.struct(F.concat("word", F.lit("$")).alias("e"), before.alias("h"), F.lit(0).alias("level"))]
    for k, n in enumerate(STEMS):
        pieces.append(F.when(length > n, F.struct(begin(n).alias("e"), (begin(STEMS[k - 1]) if k else F.lit("")).alias("h"), F.lit(n).alias("level"))))
    # a word is one of its kind, a beginning gathers all words that have it
    parts = words.select("t", "o", F.inline(F.array_compact(F.array(*pieces))))
    parts = stored(spark, parts.groupBy("e", "h", "level").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("kinds")), "pieces")
    held = [F.sum(F.least(F.col(c).cast("double"), off(c))).alias(f"held_{c}") for c in "to"]
    under = stored(spark, parts.groupBy(F.col("h").alias("at")).agg(*[F.sum(c).alias(f"all_{c}") for c in "to"], *held, F.sum("kinds").alias("all_kinds")), "under")

    def chance(c: str, share: Column, count: Column | None) -> Column:
        own = F.greatest(count - off(c), F.lit(0.0)) / F.col(f"all_{c}") if count is not None else F.lit(0.0)
        return F.log(F.when(F.col(f"all_{c}") > 0, own + F.col(f"held_{c}") / F.col(f"all_{c}") * share).otherwise(share))

    known, unknown = F.col("kinds") / (F.col("all_kinds") + 1), 1 / (F.col("all_kinds") + 1)
    steps = parts.join(under, parts["h"] == under["at"]).select("e", "h", "level", *[chance(c, known, F.col(c)).alias(f"l{c}") for c in "to"])
    whole = spark.createDataFrame([("", 0.0, 0.0)], "at string, wt double, wo double")
    for n in STEMS:
        up = whole.select(F.col("at").alias("h"), "wt", "wo")
        whole = whole.unionAll(steps.where(F.col("level") == n).join(up, "h").select(F.col("e").alias("at"), F.col("lt") + F.col("wt"), F.col("lo") + F.col("wo")))
    whole = stored(spark, whole, "beginnings")
    full = steps.where("level = 0").join(whole, steps["h"] == whole["at"]).select("e", (F.col("lt") + F.col("wt")).alias("lt"), (F.col("lo") + F.col("wo")).alias("lo"))
    ends = under.join(whole, "at").select(F.col("at").alias("e"), *[(chance(c, unknown, None) + F.col(f"w{c}")).alias(f"l{c}") for c in "to"])
    model = stored(spark, full.unionAll(ends), "model")
    dropped(words, parts, under, whole)
    return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lt, lo) of (expression, lt, lo) rows."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0).to_pylist()).view(np.int64)), *[batch.column(k).cast(pa.float32()) for k in (1, 2)]], ["key", "lt", "lo"])


class Model:
    """A fitted model as sorted keys of expressions and their values, with the values of late words."""

    def __init__(self, rows: Iterable[tuple[str, float, float]], blend: float) -> None:
        rows = list(rows)
        self.blend = blend
        self._hold(_keys([e for e, _, _ in rows]), np.array([(t, o) for _, t, o in rows], np.float32).reshape(-1, 2))
        self.place: dict[str, int] = {}
        self.found = np.empty((0, 2))

    def _hold(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @classmethod
    def collected(cls, table: DataFrame, blend: float) -> Model:
        """Of a table of fit_model; the executors make the keys, so that the driver gets 16 bytes a row and no text."""
        rows, out = table.mapInArrow(_packed, "key long, lt float, lo float").toArrow(), cls((), blend)
        out._hold(rows.column("key").to_numpy().view(np.uint64), np.stack([rows.column(c).to_numpy() for c in ("lt", "lo")], axis=1))
        return out

    def __getstate__(self) -> dict:
        return vars(self) | {"place": {}, "found": np.empty((0, 2))}

    def look_up(self, words: list[str]) -> np.ndarray:
        """Per word the toxic (blended) and ordinary log probability, by the first of its expressions that is known."""
        out, left = np.zeros((len(words), 2)), list(range(len(words)))
        for n in (None, *reversed(STEMS), 0):
            if n:
                # beginnings recur: each is looked up once
                now = [i for i in left if len(words[i]) > n]
                starts, where = np.unique([words[i][:n] for i in now], return_inverse=True) if now else (np.empty(0, str), np.empty(0, np.int64))
                asked = starts.tolist()
            else:
                now, asked = left, [words[i] + "$" for i in left] if n is None else [""]
                where = np.arange(len(now)) if n is None else np.zeros(len(now), np.int64)
            if not now:
                continue
            keys = _keys(asked)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit, rows = (self.keys[at] == keys)[where], np.array(now)
            out[rows[hit]] = self.values[at[where[hit]]]
            gone = set(rows[hit].tolist())
            left = [i for i in left if i not in gone]
        return np.stack([blended(out[:, 0], out[:, 1], self.blend), out[:, 1]], axis=1)

    def likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """Per text: toxic and ordinary log-likelihood over the number of different words; 0 without words."""
        out, sets = np.zeros((len(texts), 2)), [distinct_words(t) for t in texts]
        new = set().union(*sets).difference(self.place)
        if len(self.place) + len(new) > CACHED_WORDS:
            self.place, self.found, new = {}, np.empty((0, 2)), set().union(*sets)
        words = list(new)
        self.place.update(zip(words, range(len(self.found), len(self.found) + len(words)), strict=True))
        self.found = np.concatenate([self.found, self.look_up(words)])
        sizes = np.array([len(x) for x in sets], np.int64)
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(sets)), np.int64, int(sizes.sum()))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes[some]) - sizes[some]
            out[some] = np.add.reduceat(self.found[places], starts, axis=0) / sizes[some][:, None]
        return out


def blended(toxic: np.ndarray, ordinary: np.ndarray, share: float) -> np.ndarray:
    return np.logaddexp(np.log1p(-share) + ordinary, np.log(share) + toxic)


def _measure(shared):
    """(first column, both log-likelihoods) of (any, text) rows; shared: a broadcast Model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 1):
            found = model.likelihoods(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "lt", "lo"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest of the text, word, expression, place of the expression) of texts' different words."""
    from xxhash import xxh3_128_digest

    for batch in slices(batches, 0):
        for text in batch.column(0).to_pylist():
            if words := distinct_words(text):
                rows = [(w, e, k) for w in words for k, e in enumerate(expressions(w))]
                digest = xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(rows), pa.binary()), *[pa.array(list(c)) for c in zip(*rows, strict=True)]], ["digest", "word", "e", "place"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if t else None for t in batch.column(1).to_pylist()], pa.binary())], ["id", "digest"])


def _measure_by_join(source: DataFrame, model: DataFrame, kind: str, blend: float) -> DataFrame:
    """What _measure gives, by joins: the likelihoods of each different text, then each row's by its text's digest."""
    asked = source.select("text").mapInArrow(_asked, "digest binary, word string, e string, place long").join(model, "e")
    best = asked.groupBy("digest", "word").agg(F.min_by(F.struct("lt", "lo"), "place").alias("v")).select("digest", F.col("v.lt").cast("float").alias("lt"), F.col("v.lo").cast("float").alias("lo"))
    toxic = F.col("lo") + F.log((1 - blend) + blend * F.exp(F.col("lt") - F.col("lo")))
    sums = best.groupBy("digest").agg(F.avg(toxic).alias("lt"), F.avg("lo").alias("lo"))
    rows = source.mapInArrow(_digests, f"id {kind}, digest binary").join(sums, "digest", "left")
    return rows.select("id", F.coalesce("lt", F.lit(0.0)).alias("lt"), F.coalesce("lo", F.lit(0.0)).alias("lo"))


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept that fit (value, label, count) rows, by Newton steps with a slight ridge."""
    x, y, n = (np.array([r[k] for r in rows], float) for k in range(3))
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * (p - y)) + 1e-2 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings | None = None) -> DataFrame:
    """(id, score, toxic_log_likelihood, ordinary_log_likelihood) of every document, the last two by word; models and curve come from the labelled
    documents for which learn_from, a condition on the id column, holds."""
    settings, spark = settings or Settings(), docs.sparkSession
    named = labels.select(F.col(id_col).alias("__key"), F.col(label).cast("int").alias("toxic")).where("__key is not null and toxic in (0, 1)")
    named = named.groupBy("__key").agg(F.max("toxic").alias("toxic"))
    source = docs.select(F.col(id_col), F.col(text).cast("string").alias("__text"))
    known = source.where(learn_from) if learn_from is not None else source
    if named.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        named = F.broadcast(named)
    known = known.join(named, known[id_col] == named["__key"]).select(F.col("__text").alias("text"), "toxic")
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(settings.curve_part)) == 0
    model = fit_model(known.where(~part).select("text", F.col("toxic").cast("int")))
    source = source.select(F.col(id_col).alias("id"), F.col("__text").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        seen = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return source.select(F.col("id").alias(id_col), F.lit(float(seen)).alias("score"), F.lit(0.0).alias("toxic_log_likelihood"), F.lit(0.0).alias("ordinary_log_likelihood"))
    if model.count() <= settings.broadcast_rows:
        shared = spark.sparkContext.broadcast(Model.collected(model, settings.toxic_words))
        dropped(model)

        def measured(frame: DataFrame, kind: str) -> DataFrame:
            return frame.mapInArrow(_measure(shared), f"id {kind}, lt double, lo double")
    else:

        def measured(frame: DataFrame, kind: str) -> DataFrame:
            return _measure_by_join(frame, model, kind, settings.toxic_words)

    # the curve is of hundredths, and fitted on a histogram whose ends are gathered, so its size is fixed
    x = 100 * (F.col("lt") - F.col("lo"))
    step = F.round(F.greatest(F.lit(-2.0), F.least(F.lit(50.0), x)) * 20) / 20
    values = measured(known.where(part).select(F.col("toxic").cast("long").alias("id"), "text"), "bigint")
    rows = [(r.x, r.id, r["count"]) for r in values.groupBy("id", step.alias("x")).count().collect()]
    slope, intercept = _logistic([*rows, (-1.0, 0, 1), (3.0, 1, 1)])
    out = measured(source, kind)
    return out.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-(x * slope + intercept)))).alias("score"), F.col("lt").alias("toxic_log_likelihood"), F.col("lo").alias("ordinary_log_likelihood"))
