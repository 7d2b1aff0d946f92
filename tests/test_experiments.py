import random

from binloom import __main__ as cli
from binloom import experiments
from binloom.operators import evaluate, minhash
from binloom.plans.params import LinkageParams
from binloom.sources import records


def _books(path, rng, n):
    rows = [[str(k), f"title {k * 7919 % 1000} of book", "ann" if rng.random() < 0.9 else "an", "lee"] for k in range(n)]
    path.write_text("[" + ",".join('["' + '","'.join(r) + '"]' for r in rows) + "]")


def test_linkage_from_files_to_table(spark, tmp_path):
    rng = random.Random(1)
    _books(tmp_path / "a.json", rng, 30)
    _books(tmp_path / "b.json", rng, 25)
    asked = ["linkage", "books", str(tmp_path / "a.json"), str(tmp_path / "b.json"), "-o", str(tmp_path), "-l", "64", "-d", "2", "4", "-n", "10", "20"]
    paths = [cli.main(asked, spark) for _ in range(2)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["books_exp_0.csv", "books_exp_1.csv"]
    rows = spark.read.options(header=True, inferSchema=True, quote="|").csv(paths[0]).collect()
    assert sorted((r.number_of_samples, r.num_duplicates) for r in rows) == [(10, 2), (10, 4), (20, 2), (20, 4)]
    left, right = (experiments.book_records(records.read_books(spark, str(tmp_path / f))) for f in ("a.json", "b.json"))
    grid = [LinkageParams(64, 2, d) for d in (2, 4)]
    again = evaluate.sweep(minhash.signature(left, grid[1]), minhash.signature(right, grid[1]), grid, [10, 20]).collect()
    assert sorted(r.num_comparisons for r in again) == sorted(r.num_comparisons for r in rows)


def test_voters_are_sampled_once(spark, tmp_path):
    names = "\t".join(records.VOTER)
    lines = [names] + [f"N{k}\tAnn\tB\tC\t{30 + k}\tNC\t2014-01-01" for k in (3, 1, 2)] + ["N0\tAnn\t\tC\t30\tNC\t2014-01-01"]
    (tmp_path / "v.txt").write_bytes(("\n".join(lines) + "\n").encode("utf-16-le"))
    first = experiments.voter_sample(spark, str(tmp_path / "v.txt"), 2, str(tmp_path / "2.txt"))
    assert [(r.ncid, r.birth_yr) for r in first.orderBy("ncid").collect()] == [("N1", "1983"), ("N2", "1982")]
    again = experiments.voter_sample(spark, str(tmp_path / "gone.txt"), 2, str(tmp_path / "2.txt"))
    assert sorted(experiments.voter_records(again).collect()) == sorted(experiments.voter_records(first).collect())


def test_sets_from_files_and_at_random(spark, tmp_path):
    (tmp_path / "x").write_text("5 9 7 1 1")
    (tmp_path / "y").write_text("7 5 2")
    out = cli.main(["intersect", str(tmp_path / "x"), str(tmp_path / "y"), "-b", "2", "-s", "4", "-o", str(tmp_path / "z")], spark).split("\n")
    assert "".join(f.read_text() for f in sorted((tmp_path / "z").glob("part-*"))) == "5\n7\n"
    found = {r.metric: r.number for r in records.parse_metrics(spark.createDataFrame([(x,) for x in out], "value string")).collect()}
    assert set(found) == {"total_time", "cpu_time", "number_comparison"} and found["number_comparison"] > 0
    path = cli.main(["sets", "-o", str(tmp_path / "o"), "-n", "20", "-r", "1", "-b", "2", "-s", "8"], spark)
    (row,) = spark.read.option("quote", "|").csv(path).collect()
    assert len(row) == 6 and row[0] == "20" and row[1] == "2"
    assert len(list((tmp_path / "o").glob("run_20_1_0.txt"))) == 1


def test_products_and_results_are_read_and_written(spark, tmp_path):
    (tmp_path / "p.csv").write_text('idAmazon,title,description\n1,"a, b","c ""d"""\n2,x,\n')
    assert [tuple(r) for r in records.read_products(spark, str(tmp_path / "p.csv"), "idAmazon", "title").collect()] == [("1", 'a, bc "d"')]
    books = spark.createDataFrame([("1", "T", "f", "l")], records.BOOK)
    records.write_books(books, str(tmp_path / "books"))
    assert spark.read.text(str(tmp_path / "books")).first().value == '["1","T","f","l"]'


def test_products_are_linked_to_their_mapping(spark, tmp_path):
    (tmp_path / "a.csv").write_text("idAmazon,title,description\na1,red lamp,for the desk\na2,blue chair,wood\na3,,gone\n")
    (tmp_path / "g.csv").write_text("idGoogleBase,name,description\ng1,red lamp,for the desk!\ng2,blue chairs,wood\ng3,green sofa,two seats\n")
    (tmp_path / "m.csv").write_text("idAmazon,idGoogleBase\na1,g1\na2,g2\na3,g3\na9,g1\n")
    path = cli.main(["products", *(str(tmp_path / f"{x}.csv") for x in "agm"), "-o", str(tmp_path), "-l", "1", "16", "-d", "4"], spark)
    rows = {r.num_bins_per_duplicate: r for r in spark.read.options(header=True, inferSchema=True, quote="|").csv(path).collect()}
    assert rows[1].known == rows[1].linked == rows[1].both == 2 and rows[1].jaccard == 1 and rows[1].comparisons == 4 * 2 * 3
    assert rows[16].false_positives == 0 and rows[16].comparisons < 24
    known = spark.read.options(header=True, quote="|").csv(str(tmp_path / "products_known_0.csv")).collect()
    assert sorted((r.left_id, r.right_text) for r in known) == [("a1", "red lampfor the desk!"), ("a2", "blue chairswood")]


def test_voters_are_sampled_by_the_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiments, "FIRST_SAMPLE", 30)
    head = "\t".join(records.VOTER)
    for name, step in (("l.txt", 1), ("r.txt", 2)):
        lines = [f"N{k:03d}\tAnn{k % 7}\tB\tC{k % 5}\t{30 + k % 40}\tNC\t2014-01-01" for k in range(0, 60, step)]
        (tmp_path / name).write_bytes(("\n".join([head, *lines]) + "\n").encode("utf-16-le"))
    asked = ["linkage", "voters", str(tmp_path / "l.txt"), str(tmp_path / "r.txt"), "-o", str(tmp_path), "-l", "64", "-d", "4", "-n", "5", "20"]
    rows = spark.read.options(header=True, inferSchema=True, quote="|").csv(cli.main(asked, spark)).collect()
    assert {r.number_of_samples: r.ground_truth_records for r in rows} == {5: 3, 20: 10}
    assert (tmp_path / "left_30.txt").exists() and spark.read.options(header=True, sep="\t").csv(str(tmp_path / "right_30.txt")).count() == 30


def test_lines_are_signed_and_timed(spark, tmp_path):
    (tmp_path / "t").write_text("one line\nother line\none line\n")
    out = cli.main(["lines", str(tmp_path / "t"), "-o", str(tmp_path / "s")], spark)
    assert out.startswith("2 lines") and spark.read.parquet(str(tmp_path / "s")).count() == 2
