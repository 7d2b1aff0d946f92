import math
import random

import pytest
from pyspark.sql import functions as F

from binloom.functions import numbers, text
from binloom.operators import blocking, evaluate, minhash, sets, staged
from binloom.plans import catalogue
from binloom.plans.params import LinkageParams, SetParams
from binloom.sources import records
from binloom.streaming import linkage

P = LinkageParams(64, 2, 4)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None)]
    return spark.createDataFrame(rows, "rec_id long, text string")


def test_ngrams_are_all_substrings(people):
    for row in people.select("text", text.ngrams(F.col("text"), 4).alias("g")).collect():
        t = row.text or ""
        assert sorted(row.g) == sorted(t[i : i + 4] for i in range(len(t) - 3))


def test_every_record_has_a_bin_per_band_in_its_range(people):
    rows = minhash.minhash_bins(people, P).collect()
    assert len(rows) == 61 * P.bands
    assert all(r.band * 64 <= r.bin < (r.band + 1) * 64 for r in rows)


def test_tokens_and_strings_sign_alike(people):
    tokens = people.withColumn("text", text.ngrams(F.col("text"), 4))
    assert sorted(minhash.signature(people, P).collect()) == sorted(minhash.signature(tokens, P).collect())


def test_comparisons_count_the_pairs_of_the_join(people):
    bins = minhash.minhash_bins(people, P)
    a, b = bins.where("rec_id % 2 = 0"), bins.where("rec_id % 2 = 1")
    assert blocking.comparisons(a, b).first()[0] == blocking.candidates(a, b).count()


def test_recall_grows_with_bands(people):
    other = people.withColumn("text", F.concat("text", F.lit("abc")))
    grid = [LinkageParams(64, 2, d) for d in (1, 2, 4)]
    rows = evaluate.sweep(minhash.signature(people, P), minhash.signature(other, P), grid).collect()
    assert [r.accuracy for r in rows] == sorted(r.accuracy for r in rows)


def test_scores_of_nothing_are_null(spark):
    none = spark.createDataFrame([], "left_id long, right_id long")
    assert evaluate.jaccard(none, none).first().jaccard is None


def test_parameters_are_checked():
    for bad in ({"bands": 0}, {"bins_per_band": 2**40}):
        with pytest.raises(ValueError):
            LinkageParams(**bad)
    with pytest.raises(ValueError):
        SetParams(bits=33)


def test_close_pairs_are_those_of_a_nested_loop(spark):
    rng = random.Random(4)
    texts = ["", "a", "b", "ab", "aaaaaaaa", "aaaaaaaab", "abababab", "aaaa", None] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    known = {t for t in texts if t is not None}
    want = {(x, y) for x in known for y in known if 10 * distance(x, y) <= 3 * min(len(x), len(y))}
    assert sorted((r.left_text, r.right_text) for r in blocking.every_close_pair(frame, frame).collect()) == sorted(want)


def test_scores_agree_with_the_parts(people):
    other = people.where("rec_id % 3 > 0").withColumn("text", F.concat("text", F.lit("a")))
    lsh = lambda d: minhash.minhash_bins(d, P)
    row = evaluate.scores(people, other, lsh, text.close).first()
    pairs, known = blocking.linked(lsh(people), lsh(other), people, other, text.close), evaluate.truth(people, other)
    assert row.jaccard == evaluate.jaccard(pairs, known).first().jaccard
    assert (row.false_positives, row.false_negatives) == (evaluate.false_positives(pairs, known).count(), evaluate.false_negatives(pairs, known).count())
    assert row.comparisons == blocking.comparisons(lsh(people), lsh(other)).first()[0]
    by_identity = evaluate.scores(people, other, lsh).first()
    assert by_identity.linked == by_identity.both == evaluate.recall(lsh(people), lsh(other), known).first().found


def test_sweep_over_sizes_is_the_parts(people):
    other = people.withColumn("text", F.concat("text", F.lit("ab")))
    a, b = minhash.signature(people, P), minhash.signature(other, P)
    rows = evaluate.sweep(a, b, [LinkageParams(64, 2, 2), P], [10, 40]).collect()
    assert [(r.number_of_samples, r.num_duplicates) for r in sorted(rows, key=lambda r: (r.number_of_samples, r.num_duplicates))] == [(10, 2), (10, 4), (40, 2), (40, 4)]
    for r in rows:
        left, right = (minhash.bins_of(x.where(F.col("rec_id") < r.number_of_samples), LinkageParams(64, 2, r.num_duplicates)) for x in (a, b))
        known = evaluate.truth(left.select("rec_id").distinct(), right.select("rec_id").distinct())
        assert r.num_comparisons == blocking.comparisons(left, right).first()[0]
        assert r.accuracy == evaluate.recall(left, right, known).first().recall


@pytest.mark.parametrize(("n", "m", "blocks"), [(300, 200, 8), (3, 5, 8), (0, 4, 4), (400, 400, 3)])
def test_staged_intersection_is_the_intersection(spark, n, m, blocks):
    rng, p = random.Random(n), SetParams(blocks, 10)
    a, b = set(rng.sample(range(1024), n)), set(rng.sample(range(1024), m))
    frames = [spark.createDataFrame([(v,) for v in s], "v long") for s in (a, b)]
    table = staged.stages(*frames, p).persist()
    assert {r.v for r in staged.compare(table).collect()} == a & b
    assert {r.v for r in sets.range_join(*frames, p).collect()} == a & b
    table.unpersist()


def test_swap_gates(spark):
    found = spark.range(1, 33).select("id", numbers.swap_gates(F.col("id")).alias("g")).collect()
    assert {r.id: r.g for r in found}.items() >= {1: 0, 2: 1, 4: 5, 8: 17, 16: 49, 32: 129}.items()
    assert all(r.g == sum(math.ceil(math.log2(i)) for i in range(1, r.id + 1)) for r in found)


def test_sources_read_back(spark, tmp_path):
    (tmp_path / "books.json").write_text('[["1","A","x","y"],["1","B","x","y"],["2","C","p","q"]]')
    books = records.read_books(spark, str(tmp_path / "books.json"))
    assert sorted((r.isbn, r.title, r.author) for r in books.collect()) == [("1", "A", "xy"), ("2", "C", "pq")]
    names = "\t".join(records.VOTER)
    (tmp_path / "v.txt").write_bytes(f"{names}\nN1\tAnn\tB\tC\t30\tNC\t2014-01-01\n".encode("utf-16-le"))
    assert records.read_voters(spark, str(tmp_path / "v.txt")).first().birth_yr == "1984"
    (tmp_path / "ints").write_text("5 7 9\n")
    assert [r.v for r in records.read_integers(spark, str(tmp_path / "ints"), 2).orderBy("pos").collect()] == [5, 7]
    assert records.random_integers(spark, 50, 8).distinct().count() == 50
    assert sorted(r.v for r in records.random_integers(spark, 16, 4).collect()) == list(range(16))


def test_stream_is_matched_with_a_table(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    out = linkage.matched(stream, spark.range(3, 5), "id").writeStream.format("memory").queryName("matched").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert sorted(r.id for r in spark.table("matched").collect()) == [3, 4]


@pytest.mark.parametrize("at_once", [5, 64, 1 << 20])
def test_signatures_are_plain_minima(spark, monkeypatch, at_once):
    """Texts in parts and together, many kinds of characters, null and repeated ids, against minima one shingle at a time."""
    from hashlib import md5

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, "", "abc", "".join(map(chr, rng.sample(range(0x100, 0xD000), 3000)))]
    rows = [(i // 2 if i else None, t) for i, t in enumerate(texts)]
    expected: dict[int | None, list[int]] = {}
    for i, t in rows:
        hashes = [int(md5(t[k : k + 4].encode()).hexdigest()[:7], 16) for k in range(len(t or "") - 3)]
        least = [min([(h * a + b) % minhash.MODULUS for h in hashes], default=minhash.MODULUS - 1) for a, b in P.coefficients]
        expected[i] = list(map(min, least, expected.get(i, least)))
    found = minhash.Minima(P)
    monkeypatch.setattr(minhash, "AT_ONCE", at_once)
    assert found.of_texts([t and t.encode() for t in texts]).T.tolist() == [[min([(int(md5(t[k : k + 4].encode()).hexdigest()[:7], 16) * a + b) % minhash.MODULUS for k in range(len(t or "") - 3)], default=minhash.MODULUS - 1) for a, b in P.coefficients] for t in texts]
    signed = minhash.signature(spark.createDataFrame(rows, "rec_id long, text string"), P).collect()
    assert {r[0]: list(r[1:]) for r in signed} == expected and len(signed) == len(expected)


def test_numbers_of_shingles_of_many_characters():
    """More kinds of characters than fit in one number: shingles are numbered anew on the way."""
    import numpy as np

    points = np.random.default_rng(1).integers(0, 0x110000, 20_000).astype(np.uint32)
    points[10_000:] = points[:10_000]
    run = minhash._numbered(points, 4)
    assert (run[: 10_000 - 3] == run[10_000:]).all() and len(np.unique(run[: 10_000])) == 10_000
    first, which = minhash._places(run)
    assert (run[first][which] == run).all()


def test_tokens_that_are_null_say_nothing(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, ["b", "a"]), (3, [None]), (4, []), (5, None)], "rec_id int, text array<string>")
    signed = {r[0]: r[1:] for r in minhash.signature(rows, P).collect()}
    assert signed[1] == signed[2] and signed[3] == signed[4] == signed[5] == (minhash.MODULUS - 1,) * P.permutations


def test_full_bins_of_candidates_meet_by_blocks(spark, monkeypatch):
    """A full bin is joined by blocks, not whole, and null ids are kept."""
    monkeypatch.setattr(blocking, "IDS", 16)
    left = spark.createDataFrame([(i, 0 if i < 200 else i) for i in range(300)] + [(None, 5)], "rec_id long, bin long")
    right = spark.createDataFrame([(i, 0 if i < 90 else i) for i in range(250)] + [(None, 5), (7, 5)], "rec_id long, bin long")
    found = blocking.candidates(left, right)
    want = left.withColumnRenamed("rec_id", "left_id").join(right.withColumnRenamed("rec_id", "right_id"), "bin").select("left_id", "right_id")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert "__lb" in found._jdf.queryExecution().toString()


def _copies(spark):
    """Two sides of few different texts, one of them in more rows than a pack holds."""
    rows = [(i, ["abcdef", "abcdeg", "xyzxyzxy", ""][i % 4] if i < 90 else "abcdef") for i in range(300)]
    left = spark.createDataFrame(rows, "rec_id long, text string")
    right = spark.createDataFrame([(i, t + "x") for i, t in rows if i % 3], "rec_id long, text string")
    return left, right, minhash.minhash_bins(left, P), minhash.minhash_bins(right, P)


def test_copies_meet_once(spark):
    left, right, a, b = _copies(spark)
    met = blocking.met_once(a, b, left, right)
    pairs = a.join(b.withColumnRenamed("rec_id", "right_id"), "bin").select(F.col("rec_id").alias("left_id"), "right_id").distinct()
    assert sorted(blocking.expanded(met).collect()) == sorted(pairs.collect())
    assert met.count() < pairs.count() / 100


def test_candidates_are_given_out_at_their_first_band(spark, monkeypatch):
    """Pairs are those of a join by band and bin, each once, and no list of bins is searched per pair."""
    monkeypatch.setattr(blocking, "IDS", 16)
    monkeypatch.setattr(blocking, "PACK", 8)
    rows = [(i, i % 3, i % 7 if i < 100 else 1, 0 if i < 60 else i) for i in range(160)]
    left = spark.createDataFrame(rows, "rec_id long, b0 int, b1 int, b2 int")
    right = spark.createDataFrame([(1000 + i, b, c, d) for i, b, c, d in rows if i % 4 and b], left.schema)
    found = blocking.candidates_once(left, right, ["b0", "b1", "b2"])
    want = sorted((x.rec_id, y.rec_id) for x in left.collect() for y in right.collect() if x.b0 == y.b0 or x.b1 == y.b1 or x.b2 == y.b2)
    assert sorted(map(tuple, found.collect())) == want
    assert "arrays_overlap" not in catalogue.QUERIES["candidate_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_listed_pairs_are_linked_without_the_others(spark):
    left, right, a, b = _copies(spark)
    known = evaluate.truth(left, right)
    found, every = blocking.linked_among(a, b, left, right, text.close, known), blocking.linked(a, b, left, right, text.close)
    assert sorted(found.collect()) == sorted(every.join(known, ["left_id", "right_id"], "left_semi").collect())
    assert 0 < found.count() < known.count() and evaluate.false_negatives(found, known).count() == known.count() - found.count()


@pytest.mark.parametrize("again", [False, True])
def test_scores_count_pairs_without_making_them(spark, again):
    """With an id there twice too, whose pairs count once."""
    left, right, a, b = _copies(spark)
    left = left.unionAll(left.where("rec_id = 4")) if again else left
    known = evaluate.truth(left, right).distinct()
    row, pairs = evaluate.scored(a, b, left, right, text.close, known).first(), blocking.linked(a, b, left, right, text.close).distinct()
    scores = evaluate.jaccard(pairs, known).first()
    assert evaluate.repeats(left, right) == again
    assert (row.both, row.linked + row.known - row.both) == (scores.both, scores.either) and row.linked == pairs.count()
    if not again:
        assert blocking.linked_count(a, b, left, right, text.close).first().linked == row.linked


def test_tokens_are_remembered_in_bounds():
    """Many different tokens in one batch, over several slices of records and of tokens: memory stays, minima are plain."""
    import numpy as np
    import pyarrow as pa

    sizes = [0, 3, *[700] * 600, 180_000]
    tokens = [str(k).encode() for k in range(sum(sizes))]
    ends = np.cumsum([0, *sizes])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.binary()))
    found = minhash.Minima(P)
    least = found.of_tokens(lists)
    assert len(found.known) <= 1 << 18
    hashes = np.array([minhash.shingle_hash(x) for x in tokens])
    for row in (1, 2, 300, 601, 602):
        own = hashes[ends[row] : ends[row + 1]]
        assert least[:, row].tolist() == [int(((own * a + b) % minhash.MODULUS).min()) for a, b in P.coefficients]
    assert (least[:, 0] == minhash.MODULUS - 1).all()
