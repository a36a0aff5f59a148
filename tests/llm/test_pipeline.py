"""The pipeline's stages, one by one: what they keep, on plain and on odd tables."""

import random

import corpus_pipeline as cp
import pytest
from lamella.llm import simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(21)
    path = str(tmp_path_factory.mktemp("tables"))
    word = lambda: draw.choice("river stone walking because morning letter quiet harbour window garden".split()) + str(draw.randrange(300))
    good = [" ".join(word() for _ in range(80)) for _ in range(60)]
    texts = good + [good[3], good[4] + " tail"] + [f"{good[5]} {good[0]}"] + ["%%% $$$ BUY 111 ### " * 20] * 3 + ["", None]
    rows = [(i, t, "en", f"s{i % 3}" if t else None, len(t or "")) for i, t in enumerate(texts)] + [(None, good[7], "en", "s1", 9), (2, good[2], "en", "s2", 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(66)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(good[0].split()[10:40])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = [r.doc_id for r in docs.collect()]
    first, lines, copies, clean = kept.values()
    assert not {63, 64, 65} & set(first) and set(range(63)) <= set(first)
    assert sorted(lines, key=str) == sorted(first, key=str)  # texts are emptied, rows stay
    assert set(range(60)) <= set(copies) and 61 not in copies and None in copies and copies.count(2) == 2
    assert not {0, 62} & set(clean) and set(range(1, 60)) <= set(clean)


def test_near_dedup_links_by_fingerprints_and_by_shingles(spark, folder):
    chorus, other = "row row row your boat gently down the stream " * 40, " ".join(f"w{i}" for i in range(100))
    tails = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 12), ("b", 12))]
    texts = {1: chorus + tails[0], 2: chorus + tails[1], 5: f"{chorus}{tails[1]} end", 7: other, 8: f"{other} end", 9: " ".join(f"v{i}" for i in range(100))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    assert {tuple(r) for r in cp.near_copies(docs).collect()} == {(5, 2), (8, 7)}  # 1 and 2 have few shingles in common, but most of their words
    assert {r.doc_id for r in cp.near_dedup(spark, docs, folder).collect()} == {1, 7, 9}


def test_near_dedup_finds_chains_of_both_kinds_at_once(spark, folder, monkeypatch):
    """One run of rounds over all links: each of three held more of the driver's memory, with hundreds of tasks a round."""
    runs, once = [], simhash.connected_components
    for module in (cp, simhash):
        monkeypatch.setattr(module, "connected_components", lambda *a, **b: runs.append(a) or once(*a, **b), raising=False)
    base = [f"w{i}" for i in range(100)]
    texts = {None: " ".join(base), 1: " ".join(base), 2: " ".join(base), 5: " ".join(reversed(base)), 6: " ".join(reversed(base)) + " end", 7: " ".join(base) + " end"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(7, " ".join(reversed(base)), "en", "s", 9)], SCHEMA)
    assert {r.doc_id for r in cp.near_dedup(spark, docs, folder).collect()} == {None, 1} and len(runs) == 1


def test_run_gives_every_kept_document_a_place(spark, folder):
    got = cp.run(spark, folder).collect()
    placed = [(r.slot, r.place) for r in got if r.slot is not None]
    assert len(placed) == len(set(placed)) and all(r.slot is None for r in got if r.source is None)
    assert set(range(1, 60)) <= {r.doc_id for r in got} and {r.source for r in got if r.slot is not None} == {"s0", "s1", "s2"}


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0
    nulls = spark.range(3).select(F.col("id").alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    assert cp.near_dedup(spark, nulls, folder).count() == 1 and cp.decontaminate(spark, nulls, folder).count() == 3
    assert cp.line_dedup(spark, nulls, folder).count() == cp.mixing(spark, nulls, folder).count() == 3
