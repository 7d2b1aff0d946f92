import json
import random

import pytest

from binloom.sources import pieces, records

NASTY = ['],["', '\\', '"', '\\"', '\\\\', "[", "]", "{", "],[", "é", "日本", "\n", "", " ", 'a\\\\"],["b', "\\" * 9, "\\" * 10 + '"']


def _array(rng, n):
    return [["".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6))) for _ in range(4)] for _ in range(n)]


@pytest.mark.parametrize(("piece", "indent"), [(7, None), (64, 1), (1 << 20, None)])
def test_elements_are_those_of_the_array(spark, tmp_path, piece, indent):
    rows = _array(random.Random(piece), 40)
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    found = sorted(pieces.json_elements(spark, str(tmp_path / "a.json"), piece).collect())
    assert [r.pos for r in found] == list(range(40)) and [json.loads(r.value) for r in found] == rows


def test_a_folder_s_arrays_follow_each_other(spark, tmp_path):
    rows = [_array(random.Random(k), n) for k, n in enumerate((3, 0, 5))]
    for k, part in enumerate(rows):
        (tmp_path / f"{k}.json").write_text(json.dumps(part))
    (tmp_path / "3.json").write_text("")
    (tmp_path / "_log").write_text("[[1]]")
    for place in (str(tmp_path), f"file://{tmp_path}"):
        found = sorted(pieces.json_elements(spark, place, 50).collect())
        assert [json.loads(r.value) for r in found] == rows[0] + rows[2] and [r.pos for r in found] == list(range(8))


def test_objects_nest_and_a_cut_array_loses_its_last(spark, tmp_path):
    (tmp_path / "o").write_text(' [ {"a": [1, {"b": "]}"}]} ,\n{"a": []}, {"a": [2')
    found = sorted(pieces.json_elements(spark, str(tmp_path / "o"), 5).collect())
    assert [json.loads(r.value) for r in found] == [{"a": [1, {"b": "]}"}]}, {"a": []}]


@pytest.mark.parametrize("piece", [1, 3, 10, 1 << 20])
def test_integers_are_those_of_the_file(spark, tmp_path, piece):
    rng = random.Random(piece)
    values = [rng.choice([0, -5, 7, 10**rng.randint(0, 18)]) for _ in range(30)]
    (tmp_path / "n").write_text(rng.choice(["", " \n"]) + "".join(f"{v}{rng.choice([' ', chr(10), '  ', chr(9)])}" for v in values) + "42")
    values.append(42)
    assert [tuple(r) for r in sorted(pieces.integers(spark, str(tmp_path / "n"), piece=piece).collect())] == list(enumerate(values))
    assert [tuple(r) for r in sorted(pieces.integers(spark, str(tmp_path / "n"), 5, piece).collect())] == list(enumerate(values))[:5]


def test_nothing_is_read_from_nothing(spark, tmp_path):
    (tmp_path / "e").write_text("")
    assert pieces.integers(spark, str(tmp_path / "e")).count() == 0 == records.read_books(spark, str(tmp_path / "e")).count()
    with pytest.raises(FileNotFoundError):
        pieces.integers(spark, str(tmp_path / "gone"))


def test_a_large_file_in_eight_pieces(spark, tmp_path):
    """100 MB in one line, in 8 pieces, as the plain reader reads it."""
    row = json.dumps(["x" * 60, 'say "],[" or \\', "é" * 20, "end"], ensure_ascii=False)
    n = 100_000_000 // (len(row.encode()) + 10)
    (tmp_path / "l.json").write_text("[" + ",".join(f'["{k:07d}",{row[1:]}' for k in range(n)) + "]", encoding="utf-8")
    size = (tmp_path / "l.json").stat().st_size
    elements = pieces.json_elements(spark, str(tmp_path / "l.json"), -(-size // 8))
    assert size > 90_000_000 and elements.rdd.getNumPartitions() == 8
    plain = spark.read.text(str(tmp_path / "l.json"), wholetext=True).selectExpr("posexplode(from_json(value, 'array<array<string>>')) as (pos, r)")
    sums = lambda d: d.selectExpr("count(*) n", "sum(xxhash64(cast(pos as long), r) % 1000003) h").first()
    assert sums(elements.selectExpr("pos", "from_json(value, 'array<string>') r")) == sums(plain)
