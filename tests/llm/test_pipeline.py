"""The corpus pipeline against plain Python and DuckDB on a small corpus, and the registered names."""

import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_minhash import _classes
from tests.llm.test_texts import _measures
from txnlens.llm.queries import SQL


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (nulls, copies, near copies, junk, leaks), labels and a benchmark."""
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(2000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(4)]
    rows = []
    for i in range(160):
        text = rng.choices(vocabulary, k=rng.choice([5, 25, 80, 300]))
        if i % 20 == 3:
            text[3:3] = items[i % 4][1].split()
        rows.append([i, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None])])
    for i in range(160, 200):
        base = rng.choice(rows[:40])[1].split()
        if i % 2 and len(base) > 50:
            base[len(base) // 2] = "changed"
        rows.append([i, " ".join(base), "en", "a"])
    rows += [[200, None, "en", "a"], [201, "", None, None], [202, "same eight words come again and again now " * 9, "en", "b"], [5, rows[5][1], "en", "c"]]
    path = str(tmp_path_factory.mktemp("corpus"))
    full = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def _step(spark, tmp_path, k, docs, path):
    name, stage = corpus_pipeline.STAGES[k]
    out = f"{tmp_path}/{k}"
    stage(spark, docs, path).write.parquet(out)
    return spark.read.parquet(out)


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    path, items = corpus
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = docs.collect()

    good = _step(spark, tmp_path, 0, docs, path)
    assert good.columns == names
    want = []
    for r in rows:
        m = _measures(r["text"])
        if m[0] >= 20 and 100 * m[4] <= 30 * m[0]:
            want.append(tuple(r))
    assert Counter(map(tuple, good.collect())) == Counter(want)  # too few labels to certify more than the base rule

    single = _step(spark, tmp_path, 1, good, path)
    assert single.columns == names
    classes = dict(_classes([(r[0], r[1]) for r in want]))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values()))

    clean = _step(spark, tmp_path, 2, single, path)
    assert clean.columns == names
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not any(t in r["text"] for _, t in items)}
    assert clean.count() < single.count()

    mixed = _step(spark, tmp_path, 3, clean, path)
    assert mixed.columns == names
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    copies = {d: taken // size for d, size, taken in db.execute(f"SELECT doc_id, size, taken FROM ({SQL['op7_mix']})").fetchall() if taken}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(copies)

    last = _step(spark, tmp_path, 4, mixed, path)
    assert last.columns == [*names, "shard", "slot"]
    got = last.collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(16) for k in range(sizes[s])]
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, mixed.collect()))


def test_run_applies_all_stages(spark, corpus):
    path, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 50


def test_empty_documents(spark, corpus, tmp_path):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k in range(5):
        docs = _step(spark, tmp_path, k, docs, path)
    assert docs.count() == 0


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
