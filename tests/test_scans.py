import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from binloom.functions import numbers, text
from binloom.operators import blocking, minhash, scans
from binloom.plans.params import LinkageParams
from binloom.sources import records, storage

ROWS = [(g, k, s, v) for k, (g, s, v) in enumerate((rng.choice([None, 1, 1, 1, 2, 3]), rng.choice("abé"), rng.choice([None, None, 1, 5, -2])) for rng in [random.Random(1)] for _ in range(400))]


@pytest.fixture(scope="module")
def frame(spark):
    rows = ROWS[:]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "g int, k long, s string, v long").repartition(6)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", 20)
    monkeypatch.setattr(scans, "FEW_KEYS", 30)


def _order(r, by):
    return ((r[0] is not None, r[0] or 0) if by else (), r[2], r[1])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_and_last_values(frame, by):
    total, last, group, want = 0, None, object(), []
    for r in sorted(ROWS, key=lambda r: _order(r, by)):
        if by and r[0] != group:
            total, last, group = 0, None, r[0]
        total, last = total + (r[3] or 0), r[3] if r[3] is not None else last
        want.append((r[1], total, total - (r[3] or 0), last))
    sums = scans.running(frame, ["s", "k"], F.col("v"), by, before="before")
    assert set(sums.columns) == {"g", "k", "s", "v", "upto", "before"}
    out = {r.k: (r.upto, r.before) for r in sums.collect()}
    fill = {r.k: r.filled for r in scans.filled(frame, ["s", "k"], F.col("v"), by).collect()}
    assert [(k, *out[k], fill[k]) for k, *_ in want] == want


def test_no_task_has_the_whole_table(spark, frame):
    for df in (scans.running(frame, ["s", "k"], F.col("v")), scans.filled(frame, ["s", "k"], F.col("v")), scans.first_rows(frame, ["s", "k"], rate=0.3), scans.dealt(frame, "s", "k", 7)):
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "GlobalLimit" not in plan and "CollectLimit" not in plan
    ranges = scans.Ranges(frame, ["s", "k"])
    counts = [r["count"] for r in ranges.marked(frame).groupBy("__scan_range").count().collect()]
    assert len(counts) > 10 and max(counts) < 80


@pytest.mark.parametrize("n", [0, 1, 29, 120, 399, 400, 999])
def test_first_rows_are_exact(frame, n):
    want = sorted(r[1] for r in sorted(ROWS, key=lambda r: (r[2], r[1]))[:n])
    assert sorted(r.k for r in scans.first_rows(frame, ["s", "k"], n).collect()) == want


def test_first_rows_of_ties_and_repeats(spark):
    rows = [(5, "x")] * 200 + [(5, "y")] * 3 + [(4, "z")] * 7 + [(None, "n")] * 2
    frame = spark.createDataFrame(rows, "a int, b string").repartition(5)
    for n in (1, 2, 5, 9, 10, 100, 211, 212):
        found = scans.first_rows(frame, ["a"], n).collect()
        assert len(found) == n and sum(r.a is None for r in found) == min(n, 2) and sum(r.a == 4 for r in found) == max(0, min(n - 2, 7))
    named = frame.select("a", F.col("b").alias("id"), F.lit("k").alias("key"))
    assert scans.first_rows(named, ["a"], 100).columns == ["a", "id", "key"] and {r.key for r in scans.first_rows(named, ["a"], 100).collect()} == {"k"}
    assert scans.first_rows(frame, ["a"], rate=0.5).count() == 106 and scans.first_rows(frame.limit(0), ["a"], rate=0.5).count() == 0


def test_keys_by_rank(frame):
    values = sorted((r[3] is not None, r[3] or 0) for r in ROWS)
    for rank in (1, 2, 200, 399, 400):
        key = scans.key_at(frame, ["v"], rank)
        assert (key.k0 is not None, key.k0 or 0) == values[rank - 1]
    assert scans.key_at(frame, ["v"], 401) is None


def test_shares_under_points(spark, frame):
    points = spark.createDataFrame([(x,) for x in (-3, -2, 0, 1, 5, 6, 6, None)], "p long")
    values = [r[3] for r in ROWS if r[3] is not None]
    want = [(p, sum(v < p for v in values), sum(v < p for v in values) / len(values)) for p in (-3, -2, 0, 1, 5, 6)]
    assert sorted(map(tuple, scans.shares_under(frame, F.col("v"), points, F.col("p")).collect())) == want
    assert {r.share for r in scans.shares_under(frame.where("false"), F.col("v"), points, F.col("p")).collect()} == {None}


def test_the_same_seed_deals_alike(frame):
    one, again, other = ({r.k: r.chunk for r in scans.dealt(d, "s", "k", 9, seed).collect()} for d, seed in ((frame, 1), (frame.repartition(3), 1), (frame, 2)))
    assert one == again != other
    for s in "abé":
        keys = [r[1] for r in ROWS if r[2] == s]
        for c in range(-(-len(keys) // 9)):
            assert sum(one[k] == c for k in keys) == min(9, len(keys) - 9 * c)


def test_files_follow_each_other(spark, frame, tmp_path):
    storage.write_in_order(frame, str(tmp_path / "o"), ["s", "k"], 5)
    rows = [r.k for f in sorted((tmp_path / "o").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    want = [r[1] for r in sorted(ROWS, key=lambda r: (r[2], r[1]))]
    assert rows == want and len(list((tmp_path / "o").glob("part-*"))) == 5
    assert [r.k for r in storage.read_in_order(spark, str(tmp_path / "o")).orderBy("pos").collect()] == want


@pytest.mark.parametrize("bits", [2, 3, 9, 12])
def test_integers_are_permuted(spark, bits):
    found = [r.v for r in records.random_integers(spark, 1 << bits, bits, 4).collect()]
    assert sorted(found) == list(range(1 << bits)) and (bits < 9 or found != sorted(found))
    large = spark.range(1000).select(numbers.permuted(F.col("id"), 62, 1).alias("v"))
    assert large.distinct().count() == 1000 and large.where("v < 0 or v >= 4611686018427387904").count() == 0


def test_comparisons_are_counted_by_the_run_itself(spark):
    rng = random.Random(3)
    people = spark.createDataFrame([(i, "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))) for i in range(90)], "rec_id long, text string")
    bins = minhash.minhash_bins(people, LinkageParams(4, 1, 3))
    seen = Observation("seen")
    blocking.linked(bins, bins, people, people, text.close, seen=seen).write.format("noop").mode("overwrite").save()
    assert seen.get["comparisons"] == blocking.comparisons(bins, bins).first()[0]


def test_full_keys_are_joined_by_blocks(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("key"))
    right = spark.range(250).select(F.col("id").alias("b"), F.when(F.col("id") < 90, 0).otherwise(F.col("id")).alias("key"))
    one, other = blocking.by_blocks(left, right, "key", "a", "b", 16)
    pairs = one.join(other, ["key", "__lb", "__rb"])
    assert sorted(pairs.select("a", "b").collect()) == sorted(left.join(right, "key").select("a", "b").collect())
    assert pairs.groupBy("key", "__lb", "__rb").count().agg(F.max("count")).first()[0] < 40 * 40
    assert LinkageParams.for_rows(1_000_000).bins_per_band == 62_500


def test_few_of_unlike_texts_are_compared(spark):
    rng = random.Random(5)
    texts = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)),) for _ in range(300)], "text string")
    assert blocking.close_candidates(texts, texts).count() < 0.05 * 300 * 300
