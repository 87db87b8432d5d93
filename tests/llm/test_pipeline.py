"""Stages and operators on rows with nulls, repeats and extra columns whose names clash with working columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm.common import remembered
from sparkloom.llm.langid import fit, predict, training_rows
from sparkloom.llm.merkle import fingerprints
from sparkloom.llm.mixing import mix, mix_plan
from sparkloom.llm.neardup import classes
from sparkloom.llm.packing import pack_documents, tokenizer_path, worker_cache
from sparkloom.llm.passages import near_passages
from sparkloom.llm.secrets import scan
from sparkloom.llm.sharding import shard_documents
from sparkloom.llm.suffixes import remove_repeats

CLASH = ("row", "base", "spans", "tokens", "random", "stratum", "lang_pred", "score", "v", "a", "b", "h1", "label", "class_id", "size", "rate", "weight", "source_size", "n", "slot", "shard", "start", "id", "key", "first", "n_hex")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
STAGES = dict(corpus_pipeline.STAGES)
SECRET = "the quick brown fox said password = abcdef12 and went home again with all of them"


def english(n: int, shift: int) -> str:
    stock = "the and house river was under green open when many people walked home slowly after long rain".split()
    return " ".join(stock[(i * i + shift * i + shift) % len(stock)] for i in range(n))


def rows() -> list[tuple]:
    texts = [None, "", "12 34", SECRET, english(80, 1), english(80, 1), english(80, 5), english(9000, 3), "casa verde río largo " * 12]
    langs = [None, "en", "en", "en", "en", None, "en", "en", "es"]
    out = [(i, t, g, [None, "s1", "s2"][i % 3], None if t is None else len(t), *CLASH) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    return [*out, out[4], (None, english(80, 9), "en", "s1", None, *CLASH), (None, None, None, None, None, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def kept_extra(frame) -> bool:
    return frame.filter(" OR ".join(f"NOT (`{c}` <=> '{c}')" for c in CLASH)).isEmpty()


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_extra_values(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert kept_extra(out)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_an_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), "").count() == 0


def test_language_stage_drops_only_what_has_no_language(spark, docs):
    left = STAGES["language_id"](spark, docs, "").filter("doc_id is not null").select("doc_id").distinct()
    assert sorted(r[0] for r in left.collect()) == [3, 4, 5, 6, 7, 8]


def test_near_dedup_stage_keeps_one_of_each_group_and_rows_without_an_id(spark, docs):
    left = [r[0] for r in STAGES["near_dedup"](spark, docs, "").select("doc_id").collect()]
    assert 4 in left and 5 not in left and left.count(None) == 2 and {0, 1, 2, 3, 6, 7, 8} <= set(left)
    assert left.count(4) == 1


@pytest.mark.parametrize("name", ["language_id", "near_dedup"])
def test_tasks_make_room_of_what_other_stages_left_in_their_worker(docs, spark, name, monkeypatch):
    """A worker lives on, and so does packing's tokenizer with up to 700,000 words: near_dedup came on top of it."""
    tasks, plain = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    STAGES[name](spark, docs, "").count()
    assert len(tasks) > 1
    for f in tasks:
        worker_cache(tokenizer_path()).encode("some words")
        list(f(iter(())))
        assert not [k for k in remembered("words") if "json" in k]


def test_secret_stage_keeps_every_row_and_masks(spark, docs):
    out = STAGES["secret_scan"](spark, docs, "")
    assert out.count() == docs.count()
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.filter("doc_id is not null").collect()}
    assert text[0] == (None, None) and "abcdef12" not in text[3][0] and text[3][1] == len(text[3][0])
    assert text[4][0] == english(80, 1)


def test_mixing_stage_repeats_as_planned(spark, docs):
    ids = [r[0] for r in STAGES["mixing"](spark, docs, "").select("doc_id").collect()]
    plan = mix_plan(docs).select("doc_id", "copies").collect()
    assert len(ids) == sum(r["copies"] for r in plan)


def test_packing_stage_covers_every_row(spark, docs):
    pieces = STAGES["packing"](spark, docs, "").toPandas()
    whole = {r[0] for r in docs.select("doc_id").collect()}
    assert set(pieces["doc_id"].dropna()) == {x for x in whole if x is not None} and pieces["doc_id"].isna().sum() >= 2


def test_run_equals_its_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


@pytest.mark.parametrize("apply", [scan, classes, near_passages, remove_repeats, fingerprints, shard_documents, mix, mix_plan, pack_documents, lambda d: predict(d, fit(training_rows(d)), ["doc_id"])], ids=["scan", "classes", "near_passages", "remove_repeats", "fingerprints", "shard_documents", "mix", "mix_plan", "pack_documents", "predict"])
def test_operators_take_clashing_columns(docs, apply):
    assert apply(docs).count() >= 0
    assert apply(docs.limit(0)).count() == 0
