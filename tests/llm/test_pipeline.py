"""The pipeline on a small fixture of whole documents, each stage against a plain version on the stage's own input."""

import math
import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_contracts import PATTERNS, WORD, _components, _histograms, _jensen_shannon, _spoiled, _whole  # noqa: E402

from binloom.llm import decontaminate, quality_rules, secret_scan  # noqa: E402

SF = "/root/testdata/sf0.001"
KEY = "q7Zt2LmX9vBc4RwK8sJd3HfN6yPg1TuE5aViSoQx"
CODE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Short documents of the table, near copies of them, edited passages of the benchmark, secrets, odd rows, and the tables that the stages read."""
    rng, where = random.Random(31), str(tmp_path_factory.mktemp("pipeline"))
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text) < 900]
    docs = sorted(docs)[:70]
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())[:5]
    added, base = [], [d for d in docs if len(WORD.findall(d[1])) > 60][:12]
    for k, d in enumerate(base[:8]):
        words = d[1].split(" ")
        words[len(words) // 2] = "changed"
        added.append((1000 + k, " ".join(words), d[2], "copies"))
    for k, (_, item) in enumerate(items):
        around = base[k % len(base)][1].split(" ")
        added.append((2000 + k, f"{' '.join(around[:20])} {_spoiled(item, int(len(item) * 0.08), rng)} {' '.join(around[20:45])}", base[k % len(base)][2], "leaks"))
    for k, d in enumerate(base[8:12]):
        added.append((3000 + k, f"{' '.join(reversed(d[1].split()))} password = hunter2hunter2{k} {KEY} end", d[2], None))
    odd = [(4000, None, None, None), (4001, "", "en", "a"), (4002, " \n\t", "en", "a"), (4003, "same words " * 400, "en", "a"), (None, base[0][1] + " without an id", "en", "a")]
    rows = [(*d, len(d[1]) if d[1] is not None else None) for d in docs + added + odd]
    spark.createDataFrame(rows, CODE).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(d[0], int(k % 3 > 0), 0) for k, d in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, place):
    """(name, input rows, output rows) of the stages in turn."""
    docs, out = spark.read.parquet(f"{place}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, place).write.parquet(f"{place}/stage-{k}")
        docs = spark.read.parquet(f"{place}/stage-{k}")
        out.append((name, before, docs))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_stage(spark, place, stages):
    name, before, after = stages[0]
    assert name == "quality_rules"
    rules = quality_rules.measured_rules(quality_rules.measures(quality_rules.known_good(before, spark.read.parquet(f"{place}/labels.parquet"))))

    def kept(text, lang):
        text = text or ""
        w = WORD.findall(text)
        seen = defaultdict(list)
        for k in range(len(w) - 4):
            seen[tuple(w[k : k + 5])].append(k)
        repeated = {p + d for at in seen.values() if len(at) > 1 for p in at for d in range(5)}
        if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
            return False
        langs = [lang] if lang in rules.common_words else list(rules.common_words)
        each = [(_histograms(text, rules.common_words[x]), x) for x in langs]
        near = len(w) < 20 or min(_jensen_shannon(h[0], rules.character_shares[x]) for h, x in each) <= rules.max_character_distance
        return near and (len(w) < 50 or min(_jensen_shannon(h[1], rules.common_shares[x]) for h, x in each) <= rules.max_common_distance)

    want = [r for r in _rows(before) if kept(r[1], r[2])]
    assert _rows(after) == want and 20 < len(want) < before.count()


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    rows = before.collect()
    lowest = {i: low for i, _, low in _components([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5, 80, 100)}
    want = sorted((tuple(r) for r in rows if r.doc_id is None or lowest[r.doc_id] == r.doc_id), key=repr)
    assert [r for r in _rows(after) if r[0] is not None] == [r for r in want if r[0] is not None] and len(want) < len(rows)


def test_benchmark_stage(spark, place, stages):
    _, before, after = stages[2]
    search = decontaminate.Search()
    normal = lambda t: decontaminate.normal(decontaminate.words_of(t))
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
    want = [r for r in _rows(before) if not _whole(normal(r[1]), items, search)]
    assert _rows(after) == want and before.count() - len(want) >= 4


def test_secret_stage(spark, stages):
    _, before, after = stages[3]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(before).collect()}
    want, masks = [], 0
    for r in before.collect():
        spans = {(m.start(), m.end()) for name, p, least in PATTERNS for m in p.finditer(r.text) if len(m[1]) >= least}
        assert spans <= {(s.start, s.end) for s in found[r.doc_id]}
        text, at = "", 0
        for start, end in sorted((s.start, s.end) for s in found[r.doc_id]):
            if start >= at:
                text += r.text[at:start] + "[SECRET]"
                masks += 1
            at = max(at, end)
        text += r.text[at:]
        want.append((r.doc_id, text, r.lang, r.source, len(text) if found[r.doc_id] else r.n_chars))
    assert _rows(after) == sorted(want, key=repr) and masks >= 4
    assert not any(KEY in r[1] or "hunter2" in r[1] for r in _rows(after))


def test_mixing_stage(stages):
    _, before, after = stages[4]
    assert after.columns == [*before.columns, "copy"]
    rows, copies = {tuple(r) for r in before.collect()}, defaultdict(list)
    for r in after.collect():
        copies[tuple(r)[:-1]].append(r["copy"])
    assert set(copies) <= rows and all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())
    words, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        n = len(WORD.findall(r[1]))
        words[r[3]] += n
        taken[r[3]] += n * len(copies[r])
        largest[r[3]] = max(largest[r[3]], n)
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight, open_, left, targets = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(order), float(sum(words.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * words[s]}
        if not full:
            targets |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            targets[s], left = 3.0 * words[s], left - 3.0 * words[s]
        open_ -= full
    for s in order:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1, s
    assert math.isclose(sum(targets.values()), sum(words.values()), rel_tol=1e-9) or sum(targets.values()) < sum(words.values())


def test_run_applies_the_stages_in_turn(spark, place, stages):
    assert _rows(corpus_pipeline.run(spark, place)) == _rows(stages[-1][2])


def test_stages_of_no_rows(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, place)
        assert out.count() == 0 and out.columns[:5] == docs.columns
