"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with
those of its language by Jensen-Shannon distance (base 2, so 0 to 1). Documents under a minimum
length are spared the comparison, because short histograms say little. Simple base rules on length
and on repeated five-word windows come first.

References and limits are parameters. `measured_rules` measures both on documents that are known to be good, with partial
sums and a row per language; the built-in ones weigh in like so many words and documents, less and less the more there are.
What is counted in texts is stored, a few hundred bytes a document; a report draws references, limits and verdicts from that,
so texts are taken apart once. Documents are not shuffled.

Defined results: tables without rows give none, and the built-in rules; very long texts are counted whole, in n log n; a
null or empty text has no words and fails the base rules; a null or unknown
language is compared with every reference and the nearest counts; repeated rows and ties are judged
alike; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm.shared import dropped, shared_dir, stored, text_or_empty, words

# Frequent words of each language, the most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "be", "by", "on", "are", "was", "this", "from", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "pour", "dans", "est", "qui", "par", "sur", "au", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
# Shares of lower-case and other letters, capitals, digits, punctuation, symbols, white space in edited prose.
CHARACTER_SHARES = [0.79, 0.02, 0.005, 0.025, 0.001, 0.159]
#: Labels up to this many go to each executor whole (8 bytes a row); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Steps from 0 to 1 in which distances are counted for their limits.
LIMIT_STEPS = 10_000


def _default_words() -> dict[str, list[float]]:
    """Zipf-Mandelbrot shares for the listed words, which make up two fifths of running prose; the last class is all other words."""
    weights = [1 / (rank + 2.7) for rank in range(20)]
    return {lang: [0.4 * w / sum(weights) for w in weights] + [0.6] for lang in COMMON_WORDS}


@dataclass(frozen=True)
class Rules:
    """Thresholds. Lengths in words; distances above a limit reject."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_words_for_characters: int = 20
    max_character_distance: float = 0.35
    min_words_for_common: int = 50
    max_common_distance: float = 0.47
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)
    character_shares: dict[str, list[float]] = field(default_factory=lambda: {lang: CHARACTER_SHARES for lang in COMMON_WORDS})
    common_shares: dict[str, list[float]] = field(default_factory=_default_words)


def _distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a count array and reference shares; 1 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    each = F.zip_with(counts, F.array(*[F.lit(float(s)) for s in shares]), lambda c, q: part(c / total, (c / total + q) / 2) + part(q, (c / total + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))).otherwise(F.lit(1.0))


def _by_language(lang: Column, each: dict[str, Column]) -> Column:
    """The value for the row's language, or the least of all for any other language."""
    other = F.least(*each.values()) if len(each) > 1 else next(iter(each.values()))
    return reduce(lambda out, kv: F.when(lang == kv[0], kv[1]).otherwise(out), each.items(), other)


def _repeated_words(frame: DataFrame, window: int) -> DataFrame:
    """Adds __repeat: words inside windows that occur twice or more. Reads __w and __n.

    Sorting (window hash, position) pairs puts equal windows side by side, so a long text costs n log n.
    """
    hashes = F.when(
        F.col("__n") > window,
        F.transform(F.sequence(F.lit(0), (F.col("__n") - window).cast("int")), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(window)])),
    )
    frame = frame.withColumn("__h", hashes)
    frame = frame.withColumn("__twice", F.coalesce(F.size(F.array_distinct("__h")) < F.size("__h"), F.lit(False)))
    frame = frame.withColumn("__s", F.when(F.col("__twice"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, at: F.coalesce(F.get("__s", at)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.array_compact(F.transform("__s", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["total"] + window - F.greatest(F.lit(0), a["end"] - p)).cast("long").alias("total"), (p + window).alias("end")), lambda a: a["total"])
    return frame.withColumn("__repeat", F.when(F.col("__twice"), covered).otherwise(F.lit(0).cast("long")))


def _measured(docs: DataFrame, rules: Rules, text: str, lang: str | None) -> DataFrame:
    """docs packed in __row, with the measures as columns of which all names start with __."""
    frame = docs.select(F.struct("*").alias("__row"), text_or_empty(docs[text]).alias("__t"), (docs[lang].cast("string") if lang else F.lit(None).cast("string")).alias("__lang"))
    frame = frame.withColumn("__w", words(F.col("__t")))
    frame = frame.withColumn("__n", F.size("__w").cast("long"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    # what is neither a small letter nor white space is a few hundredths of a text, so the exact counts are cheap
    frame = frame.withColumn("__odd", F.regexp_replace("__t", r"[a-zß-öø-ÿ\x20\x09-\x0D]+", "")).withColumn("__lines", lines)
    gone = lambda chars: (F.length("__odd") - F.length(F.regexp_replace("__odd", chars, ""))).cast("long")
    frame = frame.withColumns(
        {
            "__word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "__symbols": gone(r"[#*$%&|<>]+"),
            "__dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__upper": gone("[A-ZÀ-ÖØ-Þ]+"),
            "__digits": gone("[0-9]+"),
            "__punct": gone(r"[.,;:!?'\"()\-]+"),
            "__chars": F.length("__t").cast("long"),
        }
    )
    frame = _repeated_words(frame, rules.window)
    letters = F.col("__word_chars") - F.col("__upper") - F.col("__digits") - F.col("__punct") - F.col("__symbols")
    classes = [letters, F.col("__upper"), F.col("__digits"), F.col("__punct"), F.col("__symbols"), F.col("__chars") - F.col("__word_chars")]
    listed = sorted({w for ws in rules.common_words.values() for w in ws})
    frame = frame.withColumns({"__classes": F.array(*[c.cast("double") for c in classes]), "__known": F.filter("__w", lambda w: w.isin(listed))})
    return frame


def _word_histogram(listed: list[str]) -> Column:
    def count(word: str) -> Column:
        return F.size(F.filter("__known", lambda w: w == word)).cast("double")

    counts = [count(word) for word in listed]
    seen = F.size(F.filter("__known", lambda w: w.isin(listed))).cast("double")
    return F.array(*counts, F.col("__n") - seen)


def _counted(docs: DataFrame, rules: Rules, text: str, lang: str | None, keep: list[str] | None = None) -> DataFrame:
    frame = _measured(docs, rules, text, lang)
    frame = frame.withColumn("__failed", (F.col("__n") < rules.min_words) | (100 * F.col("__repeat") > rules.max_repeat_percent * F.col("__n")))
    listed = list(rules.common_words)
    needed = lambda k: F.col("__lang").eqNullSafe(k) | ~F.coalesce(F.col("__lang").isin(listed), F.lit(False))
    frame = frame.withColumns({f"__hist_{i}": F.when(needed(k), _word_histogram(ws)) for i, (k, ws) in enumerate(rules.common_words.items())})
    row = F.struct(*[F.col("__row")[c].alias(c) for c in keep]) if keep else F.col("__row")
    return frame.select(row.alias("__row"), "__lang", "__n", "__word_chars", "__symbols", "__dup_lines", "__repeat", "__failed", "__classes", *[f"__hist_{i}" for i in range(len(listed))])


def measures(docs: DataFrame, rules: Rules | None = None, text: str = "text", lang: str | None = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs packed in __row (of the columns `keep` alone, if given) with all that is counted in a text: what references are fitted on and documents are judged by. Only the rules' lists and lengths count here, not their references or limits.

    A table in the shared folder: a plan that goes on from there would write the measures out in terms of the text, many times over.
    """
    shared_dir(docs.sparkSession)
    return stored(docs.sparkSession, _counted(docs, rules or Rules(), text, lang, keep), "measures")


def _judged(measured: DataFrame, rules: Rules) -> DataFrame:
    histogram = {k: F.col(f"__hist_{i}") for i, k in enumerate(rules.common_words)}
    frame = measured.withColumns(
        {
            "__char_distance": F.when(F.col("__n") >= rules.min_words_for_characters, _by_language(F.col("__lang"), {k: _distance(F.col("__classes"), s) for k, s in rules.character_shares.items()})),
            "__word_distance": F.when(F.col("__n") >= rules.min_words_for_common, _by_language(F.col("__lang"), {k: _distance(h, rules.common_shares[k]) for k, h in histogram.items()})),
        }
    )
    near = F.coalesce(F.col("__char_distance") <= rules.max_character_distance, F.lit(True)) & F.coalesce(F.col("__word_distance") <= rules.max_common_distance, F.lit(True))
    return frame.withColumn("__kept", ~F.col("__failed") & near)


def _report(measured: DataFrame, rules: Rules, id_col: str) -> DataFrame:
    names = {"n_words": "__n", "word_chars": "__word_chars", "n_symbols": "__symbols", "n_dup_lines": "__dup_lines", "n_repeat_words": "__repeat", "base_failed": "__failed", "character_distance": "__char_distance", "common_word_distance": "__word_distance", "kept": "__kept"}
    return _judged(measured, rules).select(F.col("__row")[id_col].alias(id_col), *[F.col(c).alias(n) for n, c in names.items()])


def quality_report(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row per document: counts, both distances (null where too short to compare) and the verdict."""
    rules = rules or Rules()
    return _report(measures(docs, rules, text, lang, [id_col]), rules, id_col)


def keep_good(docs: DataFrame, rules: Rules | None = None, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The row number keeps the filter above the measures: pushed below them, it would be written out in terms of the text, each
    measure many times over. A stored table would do as well, but would hold all texts once more.
    """
    rules = rules or Rules()
    frame = _judged(_counted(docs, rules, text, lang), rules).withColumn("__at", F.monotonically_increasing_id())
    return frame.where(F.col("__kept") & (F.col("__at") >= 0)).select("__row.*")


def report_by_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """quality_report by rules that are measured on the documents labelled good. Texts are taken apart once."""
    measured = measures(docs, None, text, lang, [id_col])
    return _report(measured, measured_rules(_good(measured, labels, id_col, label)), id_col)


def keep_by_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """keep_good by rules that are measured on the documents labelled good. These documents' texts are taken apart twice, since only counts are stored."""
    measured = measures(known_good(docs, labels, id_col, label), None, text, lang, [id_col])
    rules = measured_rules(measured)
    dropped(measured)
    return keep_good(docs, rules, text, lang)


def _good(measured: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    return known_good(measured.withColumn("__id", F.col("__row")[id_col]), labels.select(labels[id_col].alias("__id"), labels[label].alias(label)), "__id", label)


def fit_references(measured: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Of measures(), per language of the rules that they have, what is counted over all of them: (lang, characters, character_shares, words, common_shares)."""
    rules = rules or Rules()
    frame = measured.where(F.col("__lang").isin(list(rules.common_words)))
    hist = reduce(lambda out, kv: F.when(F.col("__lang") == kv[1], F.col(f"__hist_{kv[0]}")).otherwise(out), enumerate(rules.common_words), F.lit(None).cast("array<double>"))
    frame = frame.withColumn("__hist", hist)
    size = 1 + max(map(len, rules.common_words.values()))
    sums = lambda col, n: F.array_compact(F.array(*[F.sum(F.get(col, F.lit(i))) for i in range(n)]))
    out = frame.groupBy(F.col("__lang").alias("lang")).agg(sums("__classes", 6).alias("c"), sums("__hist", size).alias("w"))
    total = lambda col: F.aggregate(col, F.lit(0.0), lambda a, y: a + y)
    share = lambda col: F.transform(col, lambda x: F.try_divide(x, total(F.col(col))))
    return out.select("lang", total(F.col("c")).alias("characters"), share("c").alias("character_shares"), total(F.col("w")).alias("words"), share("w").alias("common_shares"))


def measured_rules(measured: DataFrame, rules: Rules | None = None, prior_words: float = 2_000.0, prior_documents: float = 300.0) -> Rules:
    """The rules with references and limits measured on documents that are known to be good, given by their measures().

    What is measured and what is built in are weighed by size, by one rule at every size: built-in references count like
    `prior_words` words (and six times so many characters), built-in limits like `prior_documents` documents. A measured
    limit is a twentieth over the distance that one document in a thousand exceeds. Without documents the rules stay.
    """
    rules = rules or Rules()
    characters, common = dict(rules.character_shares), dict(rules.common_shares)

    def mixed(measured: list[float], n: float, built_in: list[float], prior: float) -> list[float]:
        return [(m * n + b * prior) / (n + prior) for m, b in zip(measured, built_in, strict=True)]

    for r in fit_references(measured, rules).collect():
        if r.characters and r.words:
            characters[r.lang] = mixed(r.character_shares, r.characters, characters[r.lang], 6 * prior_words)
            common[r.lang] = mixed(r.common_shares, r.words, common[r.lang], prior_words)
    rules = replace(rules, character_shares=characters, common_shares=common)
    found = _judged(measured, rules).where(~F.col("__failed")).select("__char_distance", "__word_distance")
    # counted by steps, so that the limits are the same whatever the order in which rows are met; at most 2 * (LIMIT_STEPS + 1) rows come to the driver
    steps = found.groupBy(*[F.floor(F.col(c) * LIMIT_STEPS).alias(k) for k, c in (("c", "__char_distance"), ("w", "__word_distance"))]).count()
    each = steps.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("step"), F.col("count").alias("n")) for k in "cw"])))
    counts = each.where("step is not null").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()

    def limit(kind: str, built_in: float) -> float:
        own = [(r.step, r.n) for r in counts if r.kind == kind]
        n = sum(k for _, k in own)
        return (n * 1.05 * _exceeded_by(0.001, own) + prior_documents * built_in) / (n + prior_documents)

    return replace(rules, max_character_distance=limit("c", rules.max_character_distance), max_common_distance=limit("w", rules.max_common_distance))


def _exceeded_by(share: float, counts: list[tuple[int, int]]) -> float:
    """Of (step, rows) counts, the upper end of the first step that this share of rows at most lies above."""
    left = sum(n for _, n in counts)
    most = share * left
    for step, n in sorted(counts):
        left -= n
        if left <= most:
            return (step + 1) / LIMIT_STEPS
    return 1.0


def known_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents that a label calls good (1) and none calls bad. Few labels go to each executor, many are joined by shuffle."""
    found = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__key")).agg(F.min(label).alias("__least")).where("__least = 1").select("__key")
    if found.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        found = F.broadcast(found)
    return docs.join(found, docs[id_col] == found["__key"], "left_semi")
