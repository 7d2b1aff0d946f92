"""The operators against plain versions, on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from binloom.llm import chat_format, decontaminate, license_scan, mixing, ngram_join, quality_classifier, quality_rules, queries, secret_scan, toxicity, url_filter
from binloom.llm.shared import slices, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one two", "xx", "b", 7), (5, "one two", "xx", "b", 7), (5, "ONE two", "en", "b", 7), (None, "three", "de", None, 5), (6, "word " * 30_000, "en", "a", 150_000), (7, "é😀 " * 40, "fr", "a", 120)]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def _lower(text):
    return text.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))


def _set(text, n):
    w = WORD.findall(_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _components(docs, n, num, den):
    sets = [(i, _set(t, n)) for i, t, *_ in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_ngram_join(spark, docs):
    found = queries.op2_ngram_join(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(docs, 3, 90, 100)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_at_the_threshold(spark, n, num):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[: 60 - k])) for k in range(25)] + [(100 + k, " ".join([f"x{k}", *base[1:]])) for k in range(10)] + [(200 + k, "a b") for k in range(3)] + [(300, "")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, (num, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(rows, n, num, 100)


def test_near_copies_are_joined_before_trees(spark, monkeypatch):
    """Near copies are linked by the least member of their shards, so none of them goes to trees, and no table of all sets is stored."""
    words, members, columns = [f"w{i}" for i in range(120)], [], []
    rows = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(120)] + [(500, "alone in the world")]
    blocks, stored = ngram_join._blocks, ngram_join.stored
    monkeypatch.setattr(ngram_join, "_blocks", lambda m: members.append(m.count()) or blocks(m))
    monkeypatch.setattr(ngram_join, "stored", lambda s, df, name: columns.extend(df.columns) or stored(s, df, name))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (80, 100)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: 0 if k < 500 else 500 for k, _ in rows}
    assert members and sum(members) == 0 and "set" not in columns


def test_pairs_about_the_threshold_are_all_compared(spark, monkeypatch):
    """What fails in a forest leaves its shards open; copies without an id and of one id are members of their class."""
    rng, words, sparse = random.Random(11), [f"w{i}" for i in range(70)], []
    rows = []
    for k in range(90):
        own = list(words)
        for i in rng.sample(range(70), rng.randint(0, 4)):
            own[i] = f"x{rng.randint(0, 3)}"
        rows.append((k, " ".join(own)))
    rows += [(None, rows[0][1])] * 5 + [(7, rows[7][1])] * 5 + [(7, rows[8][1])]
    trees = ngram_join._tree_pairs
    monkeypatch.setattr(ngram_join, "_tree_pairs", lambda num, den, s: sparse.append(s) or trees(num, den, s))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()
    low = {}
    for i, _, c in _components([r for r in rows if r[0] is not None], 3, 90, 100):
        low.setdefault(i, set()).add(c)
    got = {}
    for r in found:
        if r.doc_id is not None:
            got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == low and len(found) == len(rows) and len({c for x in low.values() for c in x}) > 1
    assert sparse == [True, False]


def test_quality_rules(spark, docs):
    found = {r.doc_id: r for r in queries.op10_quality_rules(spark, SF).collect()}
    for i, text, _ in docs:
        text, r = text or "", found[i]
        w = WORD.findall(text)
        seen = defaultdict(list)
        for k in range(len(w) - 4):
            seen[tuple(w[k : k + 5])].append(k)
        repeated = {p + d for at in seen.values() if len(at) > 1 for p in at for d in range(5)}
        lines = Counter(x for x in text.split("\n") if WORD.search(x))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.values()) - len(lines), len(repeated), failed)
        assert not (failed and r.kept)


def _jensen_shannon(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    part = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0, (part(p, m) + part(q, m)) / 2))


def _histograms(text, listed):
    w = WORD.findall(text)
    inside = "".join(w)
    kinds = [len(re.findall(p, inside)) for p in ("[A-ZÀ-ÖØ-Þ]", "[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]")]
    return [len(inside) - sum(kinds), *kinds, len(text) - len(inside)], [*(w.count(x) for x in listed), sum(x not in listed for x in w)]


def test_quality_distances_are_those_of_plain_histograms(spark):
    docs = [r for r in table(spark, SF, "documents").collect()]
    rules = quality_rules.Rules()
    found = {r.doc_id: r for r in quality_rules.quality_report(table(spark, SF, "documents"), rules).collect()}
    compared = 0
    for d in docs:
        n = len(WORD.findall(d.text or ""))
        chars, common = _histograms(d.text or "", rules.common_words[d.lang])
        r = found[d.doc_id]
        assert (r.character_distance is None) == (n < rules.min_words_for_characters) and (r.common_word_distance is None) == (n < rules.min_words_for_common)
        if r.character_distance is not None:
            assert r.character_distance == pytest.approx(_jensen_shannon(chars, rules.character_shares[d.lang]), abs=1e-9)
        if r.common_word_distance is not None:
            compared += 1
            assert r.common_word_distance == pytest.approx(_jensen_shannon(common, rules.common_shares[d.lang]), abs=1e-9)
        near = (r.character_distance or 0) <= rules.max_character_distance and (r.common_word_distance or 0) <= rules.max_common_distance
        assert r.kept == (near and not r.base_failed)
    assert compared > 50


def test_references_are_the_sums_over_known_good_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = quality_rules.known_good(docs, labels)
    rows = good.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in labels.collect() if r.quality == 1}
    measured = quality_rules.measures(good)
    fitted = {r.lang: r for r in quality_rules.fit_references(measured).collect()}
    rules, built_in = quality_rules.measured_rules(measured), quality_rules.Rules()
    for lang in built_in.common_words:
        own = [_histograms(r.text or "", built_in.common_words[lang]) for r in rows if r.lang == lang]
        if not own:
            assert lang not in fitted and rules.common_shares[lang] == built_in.common_shares[lang]
            continue
        chars, common = ([sum(x) for x in zip(*(o[k] for o in own))] for k in (0, 1))
        assert fitted[lang].character_shares == pytest.approx([x / sum(chars) for x in chars]) and fitted[lang].words == sum(common)
        assert rules.common_shares[lang] == pytest.approx([(x + 2000 * b) / (sum(common) + 2000) for x, b in zip(common, built_in.common_shares[lang])])
    assert 0 < rules.max_character_distance < 0.5 and 0 < rules.max_common_distance < 0.5
    assert quality_rules.measured_rules(measured.where("false")) == built_in
    judged = quality_rules.quality_report(good, rules).where("not base_failed").collect()
    for limit, own, prior in ((rules.max_character_distance, [r.character_distance for r in judged if r.character_distance is not None], 0.35), (rules.max_common_distance, [r.common_word_distance for r in judged if r.common_word_distance is not None], 0.47)):
        most = (math.floor(max(own) * quality_rules.LIMIT_STEPS) + 1) / quality_rules.LIMIT_STEPS
        assert limit == pytest.approx((1.05 * len(own) * most + 300 * prior) / (len(own) + 300))


def test_limits_change_smoothly_with_size(spark):
    """More labelled documents move the limits from the built-in ones to the measured ones, by one rule: no jump between sizes."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    measured = quality_rules.known_good(quality_rules.measures(docs, keep=["doc_id"]).withColumn("doc_id", F.col("__row.doc_id")), labels)
    limits = []
    for part in (0, 2, 10, 30, 100):
        rules = quality_rules.measured_rules(measured.where(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < part))
        limits.append((rules.max_character_distance, rules.max_common_distance))
    assert limits[0] == (0.35, 0.47)
    for one, other in zip(limits, limits[1:]):
        assert all(abs(a - b) < 0.09 for a, b in zip(one, other)), limits


def test_labels_decide_one_pass_as_two(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = quality_rules.measured_rules(quality_rules.measures(quality_rules.known_good(docs, labels)))
    assert sorted(quality_rules.report_by_labels(docs, labels).collect()) == sorted(quality_rules.quality_report(docs, rules).collect())
    assert sorted(quality_rules.keep_by_labels(docs, labels).collect()) == sorted(quality_rules.keep_good(docs, rules).collect())


PATTERNS = [("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12), ("access", re.compile("(AKIA[A-Z0-9]+)"), 18), ("hex", re.compile("([0-9a-f]+)"), 16)]


def test_secret_scan(spark, docs):
    found = {r.doc_id: r for r in queries.op8_secret_scan(spark, SF).collect()}
    for i, text, _ in docs:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[1]) >= least)
        base = [f"{name}:{s}:{e}" for s, _, name, e in spans]
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), base
        assert set(base) <= set(found[i].spans.split(","))


def test_secrets_that_base_spans_cover_in_part(spark):
    key = "q7Zt2LmX9vBc4RwK8sJd3HfN6yPg1TuE5aViSoQx"
    tokens = [f"1234567890123456789-{key}", key[:20] + "0a1b2c3d4e5f60718" + key[20:], f"{key[:12]}/AKIAQZ7RTX2MPLW9SD/{key[12:24]}", "0123456789abcdef0123456789abcdef", "hello-hello-hello-1111111111111111"]
    rows = [(k, f"é {t} end") for k, t in enumerate(tokens)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    for k, t in enumerate(tokens[:3]):
        assert ("entropy", 2, 2 + len(t)) in found[k] and len(found[k]) == 2
    assert [[s[0] for s in found[k]] for k in (3, 4)] == [["hex"], ["hex"]]
    assert [r.text for r in secret_scan.redact_secrets(docs).orderBy("doc_id").collect()] == ["é [SECRET] end"] * 4 + ["é hello-hello-hello-[SECRET] end"]


def test_source_mixing(spark, docs):
    rows = queries.op4_source_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op4_source_mixing(spark, SF).collect()))
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sources = {i: s for i, _, s in docs}
    own, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"]
        own[sources[r.doc_id]] += r["size"]
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    weight = dict(zip(sorted(own, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(own)))
    left, total, want = set(own), sum(own.values()), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * own[s]}
        want |= {s: 3 * own[s] for s in over} if over else share
        total, left = total - sum(3 * own[s] for s in over), (left - over if over else set())
    for s in own:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], max(size[i] for i in size if sources[i] == s))


def test_source_mixing_meets_low_rates_of_like_documents(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "a").otherwise(F.format_string("s%03d", F.col("id") % 200)).alias("source"), F.lit(200).cast("long").alias("size"))
    out = mixing.plan_mix(rows, tuple([0.05] + [1.0] * 200)).groupBy("source").agg(F.max("__target").alias("target"), F.sum(F.col("__copies") * F.col("size")).alias("taken"), F.max("__rate").alias("rate")).collect()
    assert 0 < min(r.rate for r in out if r.source == "a") < 1 / 128
    for r in out:
        assert abs(r.taken - r.target) <= 200


def _distance(a, b):
    """Least edits that turn a into some part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_finds_exact_and_edited_passages(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven green birds watch from an old tall tree near the quiet river bank today"
    clean = " ".join(f"plain{i}" for i in range(60))
    edited = passage.replace("green", "grean").replace("quiet", "quiett")
    rows = [(1, f"{clean} {passage} {clean}"), (2, f"{clean} {edited}"), (3, clean), (4, None), (5, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, passage), (10, None), (11, "")], "item_id long, text string")
    found = decontaminate.find_passages(docs, items).collect()
    assert {r.doc_id for r in found} == {1, 2}
    for r in found:
        assert r.distance == _distance(decontaminate.normal(decontaminate.words_of(passage)), decontaminate.normal(decontaminate.words_of(rows[r.doc_id - 1][1])))
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {3, 4, 5}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_decontamination_takes_ids_of_any_type(spark, kind):
    text = "one two three four five six seven eight nine ten"
    docs, items = spark.createDataFrame([(1, text), (None, text)], "doc_id int, text string"), spark.createDataFrame([(7, text)], "item_id int, text string")
    found = decontaminate.find_passages(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), items.withColumn("item_id", F.col("item_id").cast(kind))).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == {(None if i is None else str(i) if kind == "string" else i, "7" if kind == "string" else 7, 0) for i in (1, None)}


def _spoiled(text, edits, rng, step=None):
    """text after random letter edits; with step, one substitution in every step-th word instead."""
    if step:
        return " ".join(w[: len(w) // 2] + "@" + w[len(w) // 2 + 1 :] if k % step == step - 1 else w for k, w in enumerate(text.split(" ")))
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + (rng.choice("abcdefgh") if kind else "") + text[at + (kind != 2) :]
    return text


def _whole(text, items, search):
    """Least distance to each item that some part of the text is near enough to, by plain dynamic programming."""
    out = {}
    for i, item in items:
        distance = _distance(item, text)
        if distance <= int(len(item) * search.max_edit_rate):
            out[i] = distance
    return out


def test_decontamination_finds_passages_without_a_whole_trigram():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((8, 16, 40, 60))]
    index = decontaminate.Index(items, decontaminate.Search())
    for k, item in items:
        clean = " ".join(word() for _ in range(50))
        rows = [f"{clean} {_spoiled(item, 0, rng, 3)} {clean}", " ".join(w + "," if n % 3 == 0 else w for n, w in enumerate(item.split(" "))), clean]
        assert {(d, i) for d, i, *_ in index.matches(rows)} == {(0, k), (1, k)}

def test_decontamination_equals_brute_force_up_to_the_largest_edit_rate():
    rng, search = random.Random(5), decontaminate.Search()
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 8)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 5, 8, 12, 20, 30))]
    items = [(k, t) for k, t in items if int(len(t) * search.max_edit_rate)]
    index, texts = decontaminate.Index(items, search), []
    for rate in (0.05, 0.08, 0.1, 0.13, 0.15, 0.18):
        for _, item in items * 3:
            around = [" ".join(word() for _ in range(10)) for _ in range(2)]
            texts.append(f"{around[0]} {_spoiled(item, int(len(item) * rate), rng)} {around[1]}")
    lines = [decontaminate.normal(decontaminate.words_of(t)) for t in texts]
    want = {(d, items[i][0]): n for d, line in enumerate(lines) for i, n in _whole(line, list(enumerate(t for _, t in items)), search).items()}
    assert {(d, items[i][0]): n for d, i, _, _, n in index.matches(texts)} == want
    assert len(want) > 80
    for d, i, start, end, n in index.matches(texts):
        assert _distance(items[i][1], lines[d][start:end]) == n


def test_walks_reach_their_recall_and_leave_unlike_windows(monkeypatch):
    """Of places that pieces and strings leave, walks keep 97 in 100 true ones at the largest edit rate and all unedited ones, in batches of any size."""
    rng = random.Random(8)
    letters = "etaoinshrdlu"

    def words(n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))

    def edited(text, rate):
        out = list(text)
        for _ in range(int(len(out) * rate)):
            at = rng.randrange(len(out))
            out[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
        return "".join(out)

    index = decontaminate.Index([(k, words(rng.randint(8, 60))) for k in range(60)], decontaminate.Search())
    regions = [(k, text, 12) for rate in (0, 0.05, 0.1, 0.15) for k, t in enumerate(index.texts) for text in [f"{words(2)[:7]} {edited(t, rate)} {words(3)}"]]
    met = index._walks_meet(regions)
    assert met[:60].all() and met[60:180].mean() > 0.99 and met[180:].mean() >= 0.97
    others = [((k + 1) % 60, text, 12) for k, text, _ in regions]
    assert index._walks_meet(others).mean() < 0.5
    monkeypatch.setattr(decontaminate, "WALK_CHARS", 20_000)
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    index.walked.clear()
    assert (index._walks_meet(regions) == met).all()


def test_decontamination_finds_passages_across_parts_of_a_long_document(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(4)]
    index = decontaminate.Index(items, decontaminate.Search())
    text = " ".join(" ".join(word() for _ in range(rng.randrange(30))) + " " + _spoiled(t, len(t) // 8, rng) for _, t in items)
    assert {i for _, i, *_ in index.matches([None, "", text])} == {0, 1, 2, 3}
    assert [(d, i) for d, i, *_ in index.matches(["", "a", text[:40]])] == []


def test_url_hits_match_plain_search():
    vocabulary = tuple(sorted(url_filter.VOCABULARY.items()))
    for url in (None, "", "http://a.com/porn/", "http://a.com/pornx", "http://cheap.pills.example", "http://x/cheap-CHEAP", "https://M.Free-Bets.example/win?ads", "x" * 100_000 + "/casino/"):
        low = (url or "").lower()
        found = {t: w for t, w in vocabulary if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
        strict = sum(w >= 1 for w in found.values())
        assert url_filter.term_hits(url, vocabulary) == (strict, len(found) - strict, sum(found.values()))


def test_urls_of_odd_tables(spark):
    rows = [(1, None), (1, ""), (2, "nothing"), (None, "HTTP://A.Example.com/en/7?x"), (3, "http://free-bets.example.fr"), (3, "http://free-bets.example.fr"), (4, "://"), (5, "http://win.example.fr/#a://b/c")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "verdict", "__id", "__url", "__hits", "weight")})
    found = url_filter.judge_urls(pages, queries.URL_RULES)
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in found.collect()) == sorted([(1, "", "", None, "allow")] * 2 + [(2, "", "", None, "allow"), (0, "a.example.com", "/en/7", "example.com/en/7", "allow")] + [(3, "free-bets.example.fr", "", None, "block")] * 2 + [(4, "", "", None, "allow"), (5, "win.example.fr", "/", None, "allow")], key=lambda r: (r[0], r[1], r[2]))
    assert url_filter.judge_urls(pages.where("false"), queries.URL_RULES).collect() == []
    table_ = spark.createDataFrame([("Nothing", 1.0), ("nothing", 0.2), (None, 1.0), ("", 1.0)], "term string, weight double")
    verdicts = url_filter.judge_urls(pages, queries.URL_RULES, vocabulary=url_filter.vocabulary_of(table_)).where("verdict = 'block'")
    assert [r.page_id for r in verdicts.collect()] == [2]


def test_toxicity_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8


def _plain_toxicity(train, texts, blend):
    """Both log-likelihoods of each text by models that are computed for each word as the docstring says."""
    counts = defaultdict(lambda: [0, 0])
    for text, toxic in train:
        for w in toxicity.distinct_words(text):
            counts[w][toxic] += 1
    have, kinds, after = defaultdict(lambda: [0, 0]), Counter(), defaultdict(set)
    for w, n in counts.items():
        chain = toxicity.expressions(w)
        for e in chain:
            kinds[e] += 1
            have[e] = [x + y for x, y in zip(have[e], n)]
        for e, h in zip(chain, chain[1:]):
            after[h].add(e)
    cut = [toxicity.discounts(*[sum(n[c] == j for n in counts.values()) for j in range(1, 5)]) for c in (0, 1)]
    off = lambda n, c: cut[c][min(n, 3) - 1] if n else 0.0

    def logs(word):
        out, chain = [0.0, 0.0], toxicity.expressions(word)[::-1]
        for h, e in zip(chain, chain[1:]):
            known = e in kinds
            share = (kinds[e] if known else 1) / (kinds[h] + 1)
            for c in (0, 1):
                n, own = have[h][c], have[e][c] if known else 0
                held = sum(min(have[x][c], off(have[x][c], c)) for x in after[h])
                out[c] += math.log(max(own - off(own, c), 0) / n + held / n * share if n else share)
            if not known:
                break
        return out

    found = []
    for text in texts:
        rows = [logs(w) for w in toxicity.distinct_words(text)]
        mixed = [math.log((1 - blend) * math.exp(o) + blend * math.exp(t)) for o, t in rows]
        found.append((sum(mixed) / len(rows), sum(o for o, _ in rows) / len(rows)) if rows else (0.0, 0.0))
    return found


def test_toxicity_is_that_of_plain_models_and_of_joins(spark):
    rng = random.Random(2)
    stems = ["ab", "abc", "abcdef", "xyz", "moron", "moronic", "a", "zz"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "é"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    train = [(t, rng.randrange(2)) for t in texts[:40]]
    model = toxicity.fit_model(spark.createDataFrame(train, "text string, toxic int"))
    rows = [(r.e, r.lt, r.lo) for r in model.collect()]
    asked = [*texts, None, "", "unknown Abcdefghij moronical zzz"]
    found = toxicity.Model(rows, 0.01).likelihoods(asked)
    assert [tuple(x) for x in found] == [pytest.approx(x, abs=1e-4) for x in _plain_toxicity(train, asked, 0.01)]
    source = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    joined = {r.id: (r.lt, r.lo) for r in toxicity._measure_by_join(source, model, "bigint", 0.01).collect()}
    assert [joined[k] for k in range(len(asked))] == [pytest.approx(tuple(x), abs=1e-6) for x in found]


def test_vote_model_is_plain_expectation_maximisation():
    rng = random.Random(6)
    rows = Counter()
    for _ in range(400):
        good = rng.random() < 0.7
        rows[tuple(2 if rng.random() < 0.2 else int(good == (rng.random() < 0.6 + 0.05 * k)) for k in range(quality_classifier.LABELLERS))] += 1
    votes = sorted(rows)
    p = {v: (v.count(1) + 1) / (v.count(1) + 4 * v.count(0) + 2) for v in votes}
    for _ in range(200):
        share = (sum(rows[v] * p[v] for v in votes) + 1) / (sum(rows.values()) + 2)
        said = [[[1 + sum(rows[v] * (p[v] if c else 1 - p[v]) for v in votes if v[k] == x) for x in (0, 1)] for c in (0, 1)] for k in range(quality_classifier.LABELLERS)]
        chance = lambda v, c: math.prod(said[k][c][x] / sum(said[k][c]) for k, x in enumerate(v) if x < 2)  # noqa: E731, B023
        new = {v: share * chance(v, 1) / (share * chance(v, 1) + (1 - share) * chance(v, 0)) for v in votes}
        done = max(abs(new[v] - p[v]) for v in votes) < 1e-9
        p = new
        if done:
            break
    import numpy as np

    codes = np.array([sum(x * 3**k for k, x in enumerate(v)) for v in votes])
    found, _, _ = quality_classifier.vote_model(codes, np.array([rows[v] for v in votes], float))
    assert found.tolist() == pytest.approx([p[v] for v in votes], abs=1e-6)


def test_quality_scores_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_classifier(spark, sf).join(table(spark, sf, "labels").where("quality is not null"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows) > 0


OPERATORS = {
    "quality_classifier": quality_classifier.classify_quality,
    "ngram_join": ngram_join.near_duplicates,
    "keep_one": ngram_join.keep_one,
    "secret_scan": secret_scan.scan_secrets,
    "redact": secret_scan.redact_secrets,
    "license_scan": license_scan.scan_licenses,
    "quality_rules": quality_rules.quality_report,
    "keep_good": quality_rules.keep_good,
    "mix": lambda d: mixing.mix(d, text_size=F.length(F.coalesce("text", F.lit(""))).cast("long")),
    "decontaminate": lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")),
    "toxicity": lambda d: toxicity.score_toxicity(d, d.sparkSession.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(odd, name):
    n = len(OPERATORS[name](odd).collect())
    if name not in ("keep_one", "keep_good", "license_scan", "mix"):
        assert n == len(ODD)
    assert OPERATORS[name](odd.where("false")).collect() == []
    clashing = odd.withColumns({c: F.lit(1) for c in ("id", "n", "v", "size", "cls", "kind", "words")})
    assert len(OPERATORS[name](clashing).collect()) == n


@pytest.mark.parametrize("name", ["keep_one", "redact", "keep_good", "mix", "decontaminate", "toxicity"])
def test_columns_named_as_inner_ones(odd, name):
    inner = ["__row", "__key", "__rank", "__source", "__id", "__t", "__w", "__text", "__n", "__copies", "__copy", "text_"]
    clashing = odd.withColumns({c: F.lit(1) for c in inner})
    assert len(OPERATORS[name](clashing).collect()) == len(OPERATORS[name](odd).collect())


def test_mix_puts_its_number_in_place_of_a_column(odd):
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    out = mixing.mix(odd.withColumn("copy", F.lit("old")), text_size=size, copy_col="copy")
    assert out.columns == [*odd.columns, "copy"] and {r.copy for r in out.collect()} <= {1, 2, 3}


def test_typed_parts_become_placeholders_in_order(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|image|>"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3), part("video", ref="d"), part("image"), part(None), part("text", text="end")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="ok"), part("image", ref="e", width=14, height=14), part("text", text="é")]), (2, 0, "user", None), (2, 1, None, [])]
    out = chat_format.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat_format.PART}>"), content="content")
    found = {r.conv_id: r for r in out.collect()}
    assert found[1].formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|file|><|image|><|file|>end<|im_end|>\n<|im_start|>assistant\nok<|image|>é<|im_end|>\n"
    assert [tuple(a) for a in found[1].attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 768), (0, "video", "d", 0), (0, "image", None, 0), (0, None, None, 0), (1, "image", "e", 1)]
    assert found[1].expanded_tokens == 811
    assert [found[1].formatted[s.start : s.end] for s in found[1].loss_spans] == ["ok", "é"]
    assert found[2].n_turns == 2 and found[2].attachments == [] and found[2].expanded_tokens == 0


def test_chats_of_no_rows_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(rows.where("false")).collect() == []
    clashing = rows.withColumns({c: F.lit(1) for c in ("formatted", "n_turns", "__turns", "__conv", "__turn", "attachments")})
    assert sorted(map(repr, chat_format.format_conversations(clashing).collect())) == sorted(map(repr, chat_format.format_conversations(rows).collect()))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|> \\ <\\|"), (1, 1, "assistant", ""), (1, None, None, None), (2, 0, "a\nb", "x")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("", ""), ("user", "<|im_end|> \\ <\\|"), ("assistant", "")], 2: [("a\nb", "x")]}


def test_slices_hold_all_rows_and_few_bytes():
    import pyarrow as pa

    texts = ["a" * 30, None, "", "é" * 60, "b", "c" * 100, "d" * 40, "e" * 60]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (texts, [], texts[::-1])]
    found = [s.column(0).to_pylist() for s in slices(batches, 0, 100)]
    assert sum(found, []) == texts + texts[::-1]
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 100 for s in found) and len(found) < 12


def test_toxicity_model_is_the_same_by_keys(spark):
    model = toxicity.fit_model(spark.createDataFrame([("ab abcd é", 1), ("ab xyz moronic", 0), ("abcd morons", 1)], "text string, toxic int"))
    asked = ["ab moronical", "é zz abcdef", None]
    by_rows = toxicity.Model([(r.e, r.lt, r.lo) for r in model.collect()], 0.01).likelihoods(asked)
    assert by_rows.tolist() == toxicity.Model.collected(model, 0.01).likelihoods(asked).tolist()


def test_secret_scan_of_a_long_text(spark):
    """Work grows with the text: positions, cover and masks of 12,000 tokens, and entropy tokens that no base kind covers are found."""
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words, spans, at = [], [], 0
    for k in range(12_000):
        if k % 6 == 0:
            w = f"tok-{rng.getrandbits(64):016x}"  # both a hex span and a candidate that it covers in part
            spans.append(("hex", at + 4, at + 20))
        elif k % 6 == 1:
            w = "".join(rng.choices(letters, k=40))
            spans.append(("entropy", at, at + 40))
        else:
            w = "plain"
        words.append(w)
        at += len(w) + 1
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = {(s.kind, s.start, s.end) for s in secret_scan.scan_secrets(docs).first().spans}
    planted = {s for s in spans if s[0] == "entropy"}
    assert {s for s in found if s[0] == "hex"} >= {s for s in spans if s[0] == "hex"}
    assert len(planted & found) >= 0.99 * len(planted) and all(s in planted for s in found if s[0] == "entropy" and s[2] - s[1] == 40)
    masked = secret_scan.redact_secrets(docs).first().text.split(" ")
    assert len(masked) == len(words) and [m for m, w in zip(masked, words) if w == "plain"] == ["plain"] * words.count("plain")
    assert sum("[SECRET]" in m for m in masked) >= 0.99 * 4_000


def test_planted_entropy_tokens_are_found(spark, docs):
    """The entropy step on tokens of several kinds that no pattern covers, planted in the documents' own texts: its recall, and what it says of the rest."""
    rng = random.Random(12)
    kinds = {"token": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 32), "url_safe": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 43), "upper_hex": ("0123456789ABCDEF", 40)}
    rows, where = [], {}
    for n, (i, text, _) in enumerate(docs):
        name = list(kinds)[n % 3]
        alphabet, size = kinds[name]
        token = "".join(rng.choices(alphabet, k=size - 1)) + "7"
        text = (text or "") + " "
        where[n] = (name, len(text), len(text) + size)
        rows.append((n, f"{text}{token} end"))
    found = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "entropy"} for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for name in kinds:
        own = [n for n, w in where.items() if w[0] == name]
        assert sum(where[n][1:] in found[n] for n in own) >= 0.97 * len(own), name
    extra = sum(len(found[n] - {where[n][1:]}) for n in where)
    assert extra <= 0.02 * len(rows)


def test_overlapping_constraints_are_balanced(spark):
    """Languages, long texts and the whole at once: targets are met, rates are products of one factor per constraint, and no other rates that meet them are nearer to 1."""
    rng = random.Random(21)
    rows = [(i, rng.choice(["en", "en", "de", "fr"]), int(rng.lognormvariate(5, 1.2)), "x") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, size long, __rate string")
    tests = [lambda r: r[1] == "en", lambda r: r[1] == "de", lambda r: r[2] > 300, lambda r: True]
    words = [sum(r[2] for r in rows if t(r)) for t in tests]
    targets = [0.4 * words[0], 2.0 * words[1], 0.7 * words[2], 0.8 * words[3]]
    conditions = [F.col("lang") == "en", F.col("lang") == "de", F.col("size") > 300, F.lit(True)]
    found = {r.doc_id: (r["__rate"], r["__copies"]) for r in mixing.plan_constrained(docs, list(zip(conditions, targets))).collect()}
    assert len(found) == len(rows)
    for t, target in zip(tests, targets):
        assert sum(r[2] * found[r[0]][0] for r in rows if t(r)) == pytest.approx(target, rel=1e-6)
        assert sum(r[2] * found[r[0]][1] for r in rows if t(r)) == pytest.approx(target, rel=0.02)
    assert max(c for _, c in found.values()) <= 3
    rate = {tuple(t(r) for t in tests): found[r[0]][0] for r in rows}
    log = lambda lang, long: math.log(rate[lang == "en", lang == "de", long, True])
    assert max(rate.values()) < 3 and log("en", True) - log("en", False) == pytest.approx(log("fr", True) - log("fr", False)) == pytest.approx(log("de", True) - log("de", False))
    with pytest.raises(ValueError):
        mixing.plan_constrained(docs, [(F.lit(True), 4.0 * words[3])])
    capped = mixing.plan_constrained(docs, [(F.col("lang") == "de", 3.0 * words[1]), (F.lit(True), 1.2 * words[3])]).where("lang = 'de'").select("__rate").distinct().collect()
    assert [r[0] for r in capped] == [pytest.approx(3.0)]
    assert mixing.plan_constrained(docs.limit(0), [(F.lit(True), 0.0)]).count() == 0


def test_a_plan_replaces_columns_of_its_own_names(spark):
    rows = [(i, "ab"[i % 2], 10 + i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("__words", "__target", "__rate", "__copies", "__bounds", "__source", "h", "band")])
    plain, other = mixing.plan_mix(docs), mixing.plan_mix(more)
    assert sorted(other.select(plain.columns).collect()) == sorted(plain.collect())
    assert {tuple(r) for r in other.select("__bounds", "__source", "h", "band").collect()} == {("x",) * 4}
