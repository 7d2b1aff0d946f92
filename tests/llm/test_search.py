"""Codes of vectors, nearest neighbours and ranked search against plain versions, on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import impact_search, multi_index, queries, vector_codes
from binloom.llm.shared import table

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- codes -----------------------------------------------------------------------------------------------


def _codes(rows, parts=8, entries=16, rounds=6, most=None):
    """Codes by unbounded integers, one row at a time."""
    rows = sorted(((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if most:
        rows = [(i, [max(-most, min(most, x)) for x in v], label) for i, v, label in rows]
    length = len(rows[0][1])
    ends = [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in zip(ends, ends[1:])]

    def near(k, v):
        own = v[ends[k] : ends[k + 1]]
        return min((sum((x - c) ** 2 for x, c in zip(own, entry)), e) for e, entry in enumerate(books[k]))

    for _ in range(rounds):
        new = []
        for k in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(k, v)[1], []).append(v[ends[k] : ends[k + 1]])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[k])])
        books = new
    out = [(i, label, [near(k, v) for k in range(parts)]) for i, v, label in rows]
    total = Counter()
    for _, label, n in out:
        total[label] += sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[label], digest) for i, label, n in out]


def _found_codes(frame, **options):
    return sorted((tuple(r) for r in vector_codes.compress_vectors(frame, **options).collect()), key=repr)


def test_codes_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.op11_vector_codes(spark, SF).collect())) == sorted(_codes(rows))


@pytest.mark.parametrize(("scale", "length"), [(1, 1), (1 << 12, 3), (1 << 20, 8), (1 << 26, 64)])
def test_screening_leaves_no_doubt(scale, length):
    """Entries a unit apart, far from zero: single precision can't tell them apart, whole numbers must."""
    rng = np.random.default_rng(scale)
    entries = rng.integers(-3, 4, (40, length)) + scale
    entries[20:] = entries[:20]  # ties
    x = rng.integers(-3, 4, (500, length)) + scale
    place, far, unsure = vector_codes.nearest(x, entries)
    exact = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (place == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert unsure
    loose = rng.integers(-scale, scale + 1, (500, length))
    place, far, unsure = vector_codes.nearest(loose, loose[:30])
    exact = ((loose[:, None, :] - loose[None, :30, :]) ** 2).sum(axis=2)
    assert (place == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert unsure < 500 or length == 1


def test_codes_of_odd_rows(spark):
    rng = random.Random(5)
    kept = [(i, [rng.choice([0.0, -0.5, 1.00001, -3.2, 7.25]) for _ in range(10)], rng.choice([None, 1, 2])) for i in range(1, 30)]
    kept += [(1, kept[0][1], 1), (3, kept[4][1], None), (None, kept[2][1], 2), (40, [1e30, -1e30, -1e-30] + [40000.0] * 7, 1)]
    bad = [(0, None, 1), (-1, [], 1), (-2, [NAN] * 10, 1), (50, [1.0] * 9 + [INF], 2), (51, [None] + [1.0] * 9, None), (52, [1.0] * 11, 2), (53, [1.0], 2)]
    frame = spark.createDataFrame(kept + bad, "vec_id long, embedding array<double>, label int")
    want = sorted(_codes(kept, most=vector_codes.largest_integer(10)), key=repr)
    assert _found_codes(frame) == want
    clashing = frame.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "q", "c0", "code", "error", "of", "part")])
    assert _found_codes(clashing.repartition(5)) == want
    few = frame.where("vec_id in (1, 2, 3)")
    assert _found_codes(few) == sorted(_codes([r for r in kept if r[0] in (1, 2, 3)]), key=repr)
    assert _found_codes(frame.where("vec_id = 0")) == [] == _found_codes(frame.limit(0))
    short = spark.createDataFrame([(i, [float(i % 3), 1.0], None) for i in range(20)], "vec_id long, embedding array<float>, label int")
    assert _found_codes(short) == sorted(_codes([(i, [float(i % 3), 1.0], None) for i in range(20)]), key=repr)


# ---- neighbours ------------------------------------------------------------------------------------------


def _neighbours(rows, asked, k=10):
    out = {}
    for i, v in rows:
        if asked(i):
            best = {}
            for j, w in rows:
                if j != i:
                    far = 0.0
                    for x, y in zip(v, w):
                        far += (x - y) * (x - y)
                    best[j] = min(best.get(j, INF), math.sqrt(far))
            out[i] = [(j, d) for d, j in sorted((d, j) for j, d in best.items())[:k]]
    return out


def _found_neighbours(frame, asked, k=10):
    """All of up to 256 queries are measured, and so searched until all their true neighbours are found."""
    out = {}
    for r in sorted(multi_index.nearest_neighbours(frame, asked, k, share=1.0).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    place = f"/root/testdata/{sf}"
    rows = table(spark, place, "embeddings").where("embedding is not null").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found, hits, all_ = {}, 0, 0
    for r in sorted(queries.op12_nearest_neighbours(spark, place).collect()):
        found.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 100 == 0)
    assert sorted(found) == sorted(ids[asked].tolist())
    for i in asked:
        far = np.zeros(len(x))
        for c in range(x.shape[1]):
            far += (x[:, c] - x[i, c]) ** 2
        score = dict(zip(ids.tolist(), np.sqrt(far).tolist()))
        far[i] = INF
        true = {int(ids[j]) for j in np.lexsort((ids, far))[:10]}
        own = found[int(ids[i])]
        assert [r.rank for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((score[r.vec_id], r.vec_id) for r in own)
        hits, all_ = hits + len(true & {r.vec_id for r in own}), all_ + 10
    assert hits / all_ >= 0.92


def test_neighbours_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(40)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(100, 160)] + [(1, [2.0, 2.0, 1.0])]
    bad = [(200, None), (210, []), (220, [0.0, -0.0, 0.0]), (230, [NAN, 1.0, 1.0]), (240, [INF, 1.0, 1.0]), (250, [None, 1.0, 1.0]), (260, [1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>")
    want = _neighbours(rows, lambda i: i % 10 == 0)
    asked = F.col("vec_id") % 10 == 0
    assert _found_neighbours(frame, asked) == want
    clashing = frame.repartition(7).select("*", *[F.lit("x").alias(c) for c in ("id", "v", "h", "cell", "ids", "c0", "score", "rank", "__asked")])
    assert _found_neighbours(clashing, asked) == want
    assert _found_neighbours(frame.where("vec_id in (110, 120, 200)"), asked) == {110: [(120, 0.0)], 120: [(110, 0.0)]}
    assert _found_neighbours(frame.where("vec_id = 110"), asked) == {} == _found_neighbours(frame.limit(0), asked) == _found_neighbours(frame, F.lit(False))
    least = _found_neighbours(frame, F.col("vec_id") == 1)[1]  # as a query, a repeated id is its least vector
    v = min(v for i, v in rows if i == 1)
    assert least == _neighbours([(1, v)] + [r for r in rows if r[0] != 1], lambda i: i == 1)[1]


def test_full_cells_and_many_queries_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ROWS", 16)
    monkeypatch.setattr(multi_index, "QUERIES", 8)
    rng = random.Random(7)
    rows = [(i, [1.0 + rng.random() / 1e6, 1.0, rng.random() / 1e6, 2.0]) for i in range(150)] + [(i, [rng.random() * 9 for _ in range(4)]) for i in range(150, 220)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = _found_neighbours(frame, F.col("vec_id") % 2 == 0), _neighbours(rows, lambda i: i % 2 == 0)
    assert sorted(found) == sorted(want)
    assert {q: [i for i, _ in found[q]] for q in found} == {q: [i for i, _ in want[q]] for q in want}


def test_cells_come_by_rising_sums():
    rng = np.random.default_rng(1)
    one, other = rng.random(9), rng.random(7)
    cells = list(multi_index.cells_from(one, other))
    sums = [one[c // 7] + other[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and sums == sorted(sums)


# ---- ranked search ---------------------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _ranking(docs, items, k=20):
    docs = [(i, _terms(t)) for i, t in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    total, df = sum(n for _, _, n in docs), Counter(w for _, c, _ in docs for w in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, Counter()).update(_terms(t))
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 75 + 25 * n * len(docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in terms.items() if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def _found_ranking(docs, items, **options):
    return sorted((tuple(r) for r in impact_search.search(docs, items, **options).collect()), key=repr)


def test_ranking_of_the_table(spark):
    docs, items = ([tuple(r) for r in table(spark, SF, t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, queries.op13_impact_search(spark, SF).collect()), key=repr) == _ranking(docs, items)


@pytest.mark.parametrize(("shard", "items"), [(60, 8 << 20), (1 << 22, 40)])
def test_ranking_by_shards_and_blocks_of_items(spark, monkeypatch, shard, items):
    monkeypatch.setattr(impact_search, "SHARD", shard)
    monkeypatch.setattr(impact_search, "ITEM_BYTES", items)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(5000)]
    docs = [(i % 190, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(200)]
    asked = [(i % 9, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    found = _found_ranking(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), k=5)
    assert found == _ranking(docs, asked, 5)


def test_a_search_ends_early_and_whole():
    """A rare term decides: the common one's many postings are left unread, and scores are still whole."""
    n, counts = np.full(5000, 10), np.full(5000, 1)
    counts[:3] = 2
    terms = np.concatenate([np.tile([0, 1], 3), np.zeros(4997, np.int64)])
    shard = impact_search.Shard(n, counts, terms, np.ones(len(terms), np.int64), np.array([5, 9000]), 5000, 50_000)
    wanted = np.array([1, 1])
    docs, scores, read = shard.best(np.array([0, 1]), np.array([1, 1]), wanted, 2, 1)
    assert sorted(docs.tolist()) == [0, 1, 2] and read == 3
    assert set(scores.tolist()) == {9005 * (10**9 // (1000 + 12 * 100))}


def test_ranking_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "PIECE", 50)
    docs = [(1, None), (2, ""), (3, " .,;\n\t\x7f"), (4, "Één ÉÉN éÉn 日本 日本語"), (5, "same text"), (6, "same text"), (6, "SAME text"), (None, "same text"), (7, "word, " * 3000 + "end"), (8, "a" * 500 + " b"), (9, "é" * 300 + "-é"), (-1, "same")]
    asked = [(1, "same TEXT"), (1, "text"), (2, None), (3, "..."), (4, "één 日本"), (5, "word end a b " + "a" * 500), (None, "é same")]
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    want = _ranking(docs, asked)
    assert _found_ranking(docs_, items_) == want
    more = [F.lit(1).alias(c) for c in ("id", "n", "terms", "tfs", "item", "score", "rank")]
    assert _found_ranking(docs_.select("*", *more).repartition(4), items_.select("*", *more)) == want
    assert _found_ranking(docs_.limit(0), items_) == [] == _found_ranking(docs_, items_.limit(0)) == _found_ranking(docs_.where("doc_id < 4 and doc_id > 0"), items_)
