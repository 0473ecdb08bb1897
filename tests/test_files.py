"""The source of file prefixes, and what is read through it."""

import json

import pytest

from typoforge.sources import files, readers


def test_ten_thousand_files(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"d{k}").mkdir()
        for i in range(100):
            (tmp_path / f"d{k}" / f"f{i}.json").write_text('{"metrics": {}, "per_sample": []}' if i < 3 else '{"code": "x"}\n')
    (tmp_path / "d0" / "_hidden.json").write_text("{}")
    (tmp_path / ".folder").mkdir()
    (tmp_path / ".folder" / "f.json").write_text("{}")
    found = readers.discover(spark, str(tmp_path))
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"result": 300, "dataset": 9700}
    assert found.rdd.getNumPartitions() >= 20
    assert found.filter("bytes = 13 or bytes = 14").count() == 9700


def test_heads_count_characters(spark, tmp_path):
    late = '{"per_sample": 1, "x": "' + "é" * 470 + '", "metrics": 1}'
    assert late.index('"metrics"') < 512 < len(late[: late.index('"metrics"')].encode())
    (tmp_path / "a.json").write_text(late, encoding="utf-8")
    (tmp_path / "b.json").write_text('{"per_sample": 1, "x": "' + "e" * 500 + '", "metrics": 1}')
    (tmp_path / "c.json").write_bytes("é".encode() * 1024 + b"\xff" * 9)
    (tmp_path / "d.json").write_text("")
    assert {r.path[-6:]: r.kind for r in readers.discover(spark, str(tmp_path)).collect()} == {"a.json": "result", "b.json": "dataset", "c.json": "dataset", "d.json": "dataset"}


def test_a_file_over_the_cap(spark, tmp_path):
    line = json.dumps({"code": "x" * 990}) + "\n"
    (tmp_path / "big.jsonl").write_text(line * 11_000)
    (tmp_path / "small.jsonl").write_text("one\n\n two\r\nthree")
    (tmp_path / "other.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_capped(spark, str(tmp_path)).collect()}
    assert set(rows) == {"big.jsonl", "small.jsonl"}
    big = rows["big.jsonl"]
    assert big.truncated and big.bytes == 11_000 * len(line) > 10 << 20 and big.text == line * ((10 << 20) // len(line))
    assert not rows["small.jsonl"].truncated and rows["small.jsonl"].text == "one\n\n two\r\nthree"
    lines = files.capped_lines(spark, str(tmp_path))
    assert sorted((r.number, r.line) for r in lines.filter("path like '%small%'").collect()) == [(0, "one"), (2, " two"), (3, "three")]
    assert lines.filter("path like '%big%' and truncated").count() == (10 << 20) // len(line)


@pytest.mark.parametrize("text, want", [("a\nbb\ncc", "a\nbb\n"), ("abcdefgh", "abcdef"), ("a\nb\nc\n", "a\nb\nc\n"), ("", ""), ("ab\n\n\n\n\n", "ab\n\n\n\n")])
def test_cuts(spark, tmp_path, text, want):
    """A cap of six bytes: behind the last line feed if there is one; a file within the cap is whole."""
    (tmp_path / "f.jsonl").write_text(text)
    r = files.read_capped(spark, str(tmp_path / "f.jsonl"), cap=6).first()
    assert (r.text, r.truncated) == (want, len(text) > 6)


def test_uris_and_missing_paths(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "vocab.txt").write_text("a\nb\n")
    (tmp_path / "vocab.txt").write_text("a\n")
    got = {r.path for r in readers.checkpoints(spark, str(tmp_path)).collect()}
    assert got == {str(tmp_path), str(tmp_path / "sub")}
    assert {r.path for r in readers.checkpoints(spark, f"file://{tmp_path}").collect()} == {f"file://{p}" for p in got}
    assert {r.path for r in files.file_prefixes(spark, str(tmp_path), recursive=False).collect()} == {str(tmp_path / "vocab.txt")}
    assert files.file_prefixes(spark, str(tmp_path), pattern="*.none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.file_prefixes(spark, str(tmp_path / "nowhere")).count()


def test_training_files(spark, tmp_path):
    for n in ("Train_1.json", "val.jsonl", "train.txt", "x_TRAIN.json"):
        (tmp_path / n).write_text("{}")
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.training_files(spark, str(tmp_path), "train").collect()) == ["Train_1.json", "x_TRAIN.json"]
