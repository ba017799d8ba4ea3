"""The pipeline's stages on small tables, and the registered queries against their SQL."""

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from doctriage.llm import queries
from test_simhash import _kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with planted cases, in a folder of tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = ["".join(rng.choices("aeiourstlnm", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    item = prose(30)
    docs, labels = [], []
    for i in range(400):
        text = prose(rng.randint(30, 150))
        toxic = int(i % 5 == 0)
        if toxic:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["grumpfel", "zorgwit", "bluxarg"]))
            text = " ".join(parts)
        docs.append((i, text))
        labels.append((i, 1, toxic))
    clean = [i for i, _ in docs if i % 5]
    docs += [(1000 + k, docs[i][1]) for k, i in enumerate(clean[:20])]  # exact copies
    docs += [(1100 + k, docs[i][1] + " end") for k, i in enumerate(i for i in clean if len(docs[i][1].split()) > 80)]
    docs += [(2000 + k, prose(40) + " " + item + " " + prose(200)) for k in range(5)]
    docs += [(3000, "my password = hunter2hunter2 here " + prose(60)), (None, prose(50)), (3001, None), (3002, ""), (3003, prose(20_000))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_decides(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    original = set(range(400))
    assert seen["toxicity"] & original == {i for i in original if i % 5}
    kept = seen["near_copies"]
    # The first of every group of fingerprints within 4 bits, 4-word shingles, of what the stage was given.
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()]
    assert sorted(kept, key=repr) == sorted((i for i, _ in _kept(rows)), key=repr)
    assert not any(1000 <= (i or 0) < 1100 for i in kept) and sum(1100 <= (i or 0) < 1200 for i in kept) < 25
    assert len({2000, 2001, 2002, 2003, 2004} & kept) == 5 and {None, 3000, 3001, 3003} <= kept and 3002 not in kept
    assert seen["benchmark"] == kept - {2000, 2001, 2002, 2003, 2004}
    assert seen["secrets"] == seen["packing"] == seen["benchmark"]
    texts = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}
    assert "hunter2" not in texts[3000].text and texts[3000].n_chars == len(texts[3000].text)
    whole = spark.read.parquet(str(tmp_path / "packing")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"})
    assert all(r[1] == r[2] for r in whole.collect())


def test_run_equals_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.select("doc_id").distinct().count() > 300


def test_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_of_no_use_reject_nothing(spark, small, tmp_path):
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    useless = {
        "empty": labels.where("false"),
        "null": labels.withColumn("toxic", F.lit(None).cast("int")),
        "others": labels.withColumn("doc_id", F.col("doc_id") + 10**9),
        "clean": labels.where("toxic = 0"),
        "toxic": labels.where("toxic = 1"),
    }
    for name, table in useless.items():
        table.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == docs.count(), name


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == rows
