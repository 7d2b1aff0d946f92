"""Secret scans: fixed patterns plus sliding-window entropy, with DataFrame functions only.

Base kinds are found by pattern. The entropy kind takes every long run of token characters as a
candidate, slides a window over it, and keeps the counts of the window's characters: each step adds
one character and removes one, so the Shannon entropy follows from the two counts that change. A
candidate whose best window passes its class's limit is a secret unless an allow-list entry fits
or base spans cover all of it already. If they cover it in part, the parts outside are judged as well
as the whole, and the span is the whole.

Positions are code points, ends exclusive. Null or empty texts have no spans, tables without rows give
none. Every row is judged alone: no shuffle, ties and repeated rows get equal results, other columns,
whatever their names, are left alone. Very long texts are scanned whole: work grows as n log n, since
positions come from running sums by doubling, cover from merged spans found by halving, and parts are
cut from pieces of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.llm.columns import chunks, cut, leading, let, scanned
from binloom.llm.shared import text_or_empty

# The base patterns and the characters that each must have at least.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the maximal runs of at least 16, which are the leftmost matches that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ["assign", "access", "hex", "entropy"]
SPAN = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class Entropy:
    """A window in characters, the entropy in bits that each character class must reach, and what is never a secret."""

    window: int = 20
    hex_bits: float = 3.0
    token_bits: float = 3.8
    #: no digit, or digits alone; a UUID; documentation's own placeholders; runs of one alphabet or row of keys
    allowed: tuple[str, ...] = (r"^[^0-9]+$", r"^[0-9_=+/-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|placeholder|changeme|xxxx", r"(?i)abcdefgh|qwertyui|01234567")


HEX_ALPHABET = "0123456789abcdef"
TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_RUN = r"[A-Za-z0-9+/_=-]"


def _placed(text: Column, pattern: str, rank: int) -> Column:
    """Spans and matched strings of all matches. The pieces between matches and the matches, laid end to end, give positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda piece, hit: F.struct(F.length(piece).alias("gap"), F.length(hit).alias("long"), hit.alias("hit")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())  # the piece after the last match has none

    def spans(found: Column) -> Column:
        ends = scanned(F.transform(found, lambda x: x["gap"] + x["long"]), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(found, lambda x, i: F.struct((F.get(e, i) - x["long"]).alias("start"), F.lit(rank).alias("rank"), F.get(e, i).alias("end"), x["hit"].alias("hit"))))

    return let(pairs, spans)


def _merged(spans: Column) -> Column:
    """Sorted spans put together where they overlap: (start, end), by start, apart or side by side."""

    def groups(tops: Column) -> Column:
        heads = F.array_compact(F.transform(spans, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(tops, i - 1)), F.struct(x["start"].alias("start"), i.alias("i")))))
        return let(heads, lambda h: F.transform(h, lambda x, k: F.struct(x["start"].alias("start"), F.get(tops, F.coalesce(F.get(h, k + 1)["i"], F.size(tops)) - 1).alias("end"))))

    return let(scanned(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), groups)


def _bare(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))


def window_entropy(chars: Column, alphabet: str, window: int) -> Column:
    """Largest entropy in bits of a window of an array of characters, all of the alphabet; 0 if the array is shorter.

    Counts of the window are held as groups of bits in a few longs; a step changes two of them.
    """
    bits = window.bit_length()
    each = 62 // bits
    longs, mask = -(-len(alphabet) // each), (1 << bits) - 1

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def word(place: Column) -> Column:
        return F.floor(place / each).cast("int")

    def one(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place % each) * bits)

    def held(counts: Column, place: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(place)), (place % each) * bits).bitwiseAND(F.lit(mask).cast("long")).cast("int")

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def over(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(places, i), F.get(places, i - window)
            more, less = held(acc["counts"], new), F.coalesce(held(acc["counts"], old), F.lit(0))
            changed = acc["sum"] + weight(more + 1) - weight(more) + weight(less - 1) - weight(less)
            same = F.coalesce(new == old, F.lit(False))
            total = F.when(same, acc["sum"]).otherwise(changed)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == word(new), one(new)).otherwise(F.lit(0)) - F.when(k == word(old), one(old)).otherwise(F.lit(0)))
            bits_ = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
            return F.struct(F.when(same, acc["counts"]).otherwise(counts).alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits_).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda acc: acc["best"])

    return let(F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1), over)


def _spanned(docs: DataFrame, text: str, entropy: Entropy) -> DataFrame:
    """docs packed in __row, its text as __t and all spans in order as __spans."""
    none = F.array().cast(SPAN)
    frame = docs.select(F.struct("*").alias("__row"), text_or_empty(docs[text]).alias("__t"))
    t = F.col("__t")
    run = f"(?<!{TOKEN_RUN})(?={TOKEN_RUN}*[0-9]){TOKEN_RUN}{{{entropy.window},}}"
    group = F.regexp_extract  # of a match alone, so it finds the same group
    frame = frame.withColumns(
        {
            "__assign": F.when(F.rlike(t, F.lit(ASSIGN)), _bare(F.filter(_placed(t, ASSIGN, 0), lambda x: F.length(group(x["hit"], ASSIGN, 1)) >= ASSIGN_LEAST))).otherwise(none),
            "__access": F.when(F.contains(t, F.lit("AKIA")), _bare(F.filter(_placed(t, ACCESS, 1), lambda x: F.length(x["hit"]) >= ACCESS_LEAST))).otherwise(none),
            "__hex": F.when(F.rlike(t, F.lit(HEX)), _bare(_placed(t, HEX, 2))).otherwise(none),
            "__runs": F.when(F.rlike(t, F.lit(run)), _placed(t, run, 3)),
        }
    )
    frame = frame.withColumn("__base", F.sort_array(F.concat("__assign", "__access", "__hex")))

    def judged(hit: Column) -> Column:
        fits = F.lit(False)
        for pattern in entropy.allowed:
            fits = fits | F.rlike(hit, F.lit(pattern))
        is_hex = F.rlike(hit, F.lit("^[0-9a-fA-F]+$"))
        low = window_entropy(F.split(F.lower(hit), ""), HEX_ALPHABET, entropy.window) >= entropy.hex_bits
        high = window_entropy(F.split(hit, ""), TOKEN_ALPHABET, entropy.window) >= entropy.token_bits
        return F.when(fits, F.lit(False)).when(is_hex, low).otherwise(high)

    def uncovered(x: Column) -> Column:
        """The parts of a candidate outside all base spans."""
        before = leading(F.col("__merged"), lambda b: b["end"] <= x["start"])
        upto = leading(F.col("__merged"), lambda b: b["start"] < x["end"])

        def parts(near: Column) -> Column:
            def part(k: Column) -> Column:
                return cut("__chunks", F.coalesce(F.get(near, k - 1)["end"], x["start"]), F.coalesce(F.get(near, k)["start"], x["end"]))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(near)), part), lambda p: p != "")

        return let(before, lambda b: let(F.slice("__merged", b + 1, upto - b), parts))

    def secret(x: Column) -> Column:
        # nothing is left of a candidate that base spans cover
        texts = F.filter(F.array_distinct(F.concat(F.array(x["hit"]), x["parts"])), lambda t: F.length(t) >= entropy.window)
        return (F.size(x["parts"]) > 0) & F.exists(texts, judged)

    frame = frame.withColumns({"__merged": _merged(F.col("__base")), "__chunks": F.when(F.col("__runs").isNotNull() | (F.size("__base") > 0), chunks(F.col("__t")))})
    frame = frame.withColumn("__runs", F.transform("__runs", lambda x: x.withField("parts", uncovered(x))))
    frame = frame.withColumn("__entropy", F.coalesce(_bare(F.filter("__runs", secret)), none))
    return frame.withColumn("__spans", F.when(F.size("__entropy") > 0, F.sort_array(F.concat("__base", "__entropy"))).otherwise(F.col("__base")))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", entropy: Entropy | None = None) -> DataFrame:
    """One row per document: its id, base spans and all spans, each (kind, start, end) by start, then kind."""
    frame = _spanned(docs, text, entropy or Entropy())
    return frame.select(F.col("__row")[id_col].alias(id_col), _named(F.col("__base")).alias("base"), _named(F.col("__spans")).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", length_col: str | None = None, entropy: Entropy | None = None) -> DataFrame:
    """All documents with all their columns, each secret in the text replaced by the mask.

    Overlapping spans share one mask. Texts without a secret stay as they are, nulls too. length_col,
    if given, is a column that holds the text's length in characters and is set anew where the text changes.
    """
    frame = _spanned(docs, text, entropy or Entropy()).withColumn("__all", _merged(F.col("__spans")))

    def kept(k: Column) -> Column:
        """What is before the k-th masked span and after the one before it, and the mask."""
        end = F.coalesce(F.get("__all", k)["start"], F.length("__t"))
        return F.concat(cut("__chunks", F.coalesce(F.get("__all", k - 1)["end"], F.lit(0)), end), F.when(k < F.size("__all"), F.lit(mask)).otherwise(F.lit("")))

    masked = F.array_join(F.transform(F.sequence(F.lit(0), F.size("__all")), kept), "")
    found = F.size("__spans") > 0
    frame = frame.withColumn("__new", F.when(found, masked))
    out = []
    for name in docs.columns:
        old = F.col("__row")[name]
        if name == text:
            out.append(F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(old).alias(name))
        elif name == length_col:
            out.append(F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema[name].dataType)).otherwise(old).alias(name))
        else:
            out.append(old.alias(name))
    return frame.select(*out)
