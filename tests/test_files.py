"""Readers and writers of files: round trips on small folders."""

import json

import pytest
from pyspark.errors import PySparkException

from sparkloom.sinks.datasets import append_lines, content_hash, markdown_table, tokens_by_group, write_examples, write_manifest
from sparkloom.sources.files import line_window, read_code, read_examples, read_runs, source_files, tree_rows


@pytest.fixture
def code(tmp_path):
    files = {
        "a.py": b"x = 1\n", "b.py": b"x = 1\n", "nul.py": b"a\0b", "blank.py": b" \n\n", "min.js": b"a" * 900, "crlf.py": b"y = 2\r\nz = 3\r\n", ".git/c.py": b"no = 1\n", "sub/gen_d.py": b"d = 4\n",
        "huge.py": b"#\n" * 300_000, "head.py": b"# Copyright 2020 A\n#\n#\n#\nw = 5\n", "notes.txt": b"text",
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_code_files_are_filtered_and_kept_once(spark, code):
    found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in read_code(spark, code, exclude=["*gen_*"]).collect()}
    assert found == {"a.py": "x = 1\n", "crlf.py": "y = 2\nz = 3\n", "head.py": "w = 5\n"}
    assert {r["relative"] for r in source_files(spark, code, ["py"]).select("relative").collect()} >= {"sub/gen_d.py", "nul.py"}


def test_examples_name_the_line_of_an_error(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"prompt": "p", "response": "r"}\n\n{"prompt": "q", "response": "s"}\n')
    assert [(r["line"], r["prompt"], r["response"]) for r in read_examples(spark, str(tmp_path)).orderBy("line").collect()] == [(1, "p", "r"), (3, "q", "s")]
    (tmp_path / "good.jsonl").write_text('{"prompt": "p", "response": "r"}\n{"prompt": 1\n')
    with pytest.raises(PySparkException, match=r"good.jsonl:2"):
        read_examples(spark, str(tmp_path)).collect()


def test_runs_have_their_arm_and_seed(spark, tmp_path):
    for arm, seed in (("A", 1), ("B", 2)):
        (tmp_path / arm / str(seed)).mkdir(parents=True)
        (tmp_path / arm / str(seed) / "result.json").write_text(json.dumps({"points": seed * 10}))
    assert {tuple(r) for r in read_runs(spark, str(tmp_path), "points int").collect()} == {(10, "A", 1), (20, "B", 2)}


def test_lines_and_trees(spark):
    rows = spark.createDataFrame([("a\nb\nc\nd",)], "text string")
    assert [tuple(x) for x in rows.select(line_window(rows["text"], 2, 2).alias("w")).first()["w"]] == [(2, "b"), (3, "c")]
    paths = spark.createDataFrame([("b.py",), ("src/z.py",), ("src/A.py",)], "path string")
    assert [(r["parent"], r["name"]) for r in tree_rows(paths).orderBy("place").collect()] == [("", "src"), ("", "b.py"), ("src", "A.py"), ("src", "z.py")]


def test_datasets_round_trip(spark, tmp_path):
    rows = [(i, f"{'web' if i % 2 else 'code'}:x", list(range(i + 1)), [0] + [1] * i) for i in range(6)]
    examples = spark.createDataFrame(rows, "row long, tag string, tokens array<int>, mask array<int>")
    assert write_examples(examples, f"{tmp_path}/set") == 21
    index = spark.read.parquet(f"{tmp_path}/set/index").orderBy("row").collect()
    assert [r["start"] for r in index] == [0, 1, 3, 6, 10, 15]
    back = spark.read.parquet(f"{tmp_path}/set/examples")
    same = lambda df: content_hash(df, "row", "tag", "tokens", "mask").first()[0]
    assert same(back.repartition(3)) == same(examples) != same(examples.filter("row > 0"))
    assert {tuple(r) for r in tokens_by_group(examples).collect()} == {("code", 3, 9, 6, 0.4286), ("web", 3, 12, 9, 0.5714)}
    removed = spark.createDataFrame([(9, "duplicate", "p" * 500)], "row long, reason string, prompt string")
    facts = {r["name"]: r["value"] for r in write_manifest(examples, removed, f"{tmp_path}/set", {"seed": "7"}).collect()}
    assert (facts["removed:duplicate"], facts["option:seed"], facts["content_sha256"]) == ("1", "7", same(examples))
    assert len(spark.read.json(f"{tmp_path}/set/hygiene").first()["prompt"]) == 160


def test_lines_are_appended_and_reports_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "step int, note string")
    append_lines(rows, f"{tmp_path}/log"), append_lines(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert markdown_table(rows) == "| step | note |\n| --- | --- |\n| 1 | a |"
    with pytest.raises(ValueError, match="at most"):
        markdown_table(spark.range(5), limit=3)
