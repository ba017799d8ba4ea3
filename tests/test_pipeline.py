"""The whole pipeline, its outputs, its inputs, and the shape of its plan."""

import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from doctriage import (
    ExtractOptions, Rules, analyze, classify, plan_renames, store_results, with_move_errors, with_renames, write_json, write_report,
)
from doctriage.functions.text import normalize_text
from doctriage.plans import render
from doctriage.plans.report import report_rows
from doctriage.sources.corpus import from_table, list_documents, read_text_files, spread
from doctriage.sources.shared import shared_folder
from doctriage.streaming.incremental import stream_text_files, write_json_stream, write_results_stream

OPTIONS = ExtractOptions(as_of=dt.date(2026, 12, 1))
TEXTS = {
    "docs/inv.pdf": "Invoice No: INV-123\nBill To: ACME GmbH\nInvoice Date: 01.07.2025\nAmount Due: € 123,45\n",
    "docs/tic": "E-Ticket Itinerary\nPNR: ABC123\nFlight LH123 Boarding 10:20 Gate A12 Departure FRA Arrival LHR\n",
    "docs/pas.PDF": "PASSPORT\nNationality: DEU\nGiven Names: MAX\nSurname: MUSTERMANN\nDate of Expiry: 2030-01-01\n",
    "docs/none.pdf": None,
    "docs/ünï.pdf": "Nothing",
}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(p, t, "load_error: x" if t is None else None) for p, t in TEXTS.items()]
    return spark.createDataFrame(rows, "path string, text string, errors string")


def by_path(df):
    return {r["path_in"]: r for r in df.collect()}


def test_results(docs):
    got = by_path(analyze(docs, rename=True, options=OPTIONS))
    assert {p: (r["top_class"], r["confidence"], r["path_out"]) for p, r in got.items()} == {
        "docs/inv.pdf": ("invoice", 0.9973, "docs/Inv_INV-123_ACME GmbH_123.45_2025-07-01.pdf"),
        "docs/tic": ("flight_ticket", 0.9998, "docs/Ticket_ABC123_NA_LH123_NA.pdf"),
        "docs/pas.PDF": ("passport", 0.9802, "docs/Passport_MUSTERMANN_MAX_DEU_NA.PDF"),
        "docs/none.pdf": ("other", 0.25, None),
        "docs/ünï.pdf": ("other", 0.25, None),
    }
    # Extraction follows the raw class even where the reported one is other.
    assert set(got["docs/none.pdf"]["invoice"].asDict().values()) == {None}
    assert got["docs/none.pdf"]["errors"] == "load_error: x"
    assert got["docs/tic"]["invoice"] is None and got["docs/tic"]["passport"] is None
    assert got["docs/inv.pdf"]["probabilities"] == {"invoice": 0.9973, "flight_ticket": 0.0009, "passport": 0.0009, "other": 0.0009}


def test_low_threshold_renames_empty_documents(docs):
    got = by_path(analyze(docs, rename=True, min_confidence=0.25, dest="out", options=OPTIONS))
    assert sorted(got[p]["path_out"] for p in ("docs/none.pdf", "docs/ünï.pdf")) == [
        "out/Inv_NA_NA_NA_NA-1.pdf", "out/Inv_NA_NA_NA_NA.pdf",
    ]


def test_without_rename_there_are_no_targets(docs):
    assert {r["path_out"] for r in analyze(docs, options=OPTIONS).collect()} == {None}


def test_custom_class_has_no_fields(spark):
    rules = Rules.from_dict({"receipt": {"keywords": ["till"]}})
    (row,) = analyze(spark.createDataFrame([("a.pdf", "till till till")], "path string, text string"), rules, rename=True).collect()
    assert (row["top_class"], row["path_out"], row["invoice"], row["flight_ticket"], row["passport"]) == ("receipt", None, None, None, None)


def test_json_lines(docs, tmp_path):
    write_json(analyze(docs, options=OPTIONS), str(tmp_path / "out"))
    lines = [json.loads(x) for f in glob.glob(str(tmp_path / "out" / "part-*")) for x in open(f, encoding="utf-8")]
    got = {x["path_in"]: x for x in lines}
    assert list(got["docs/inv.pdf"]) == ["path_in", "path_out", "top_class", "confidence", "probabilities", "extracted", "errors"]
    assert got["docs/inv.pdf"]["extracted"] == {
        "invoice_number": "INV-123", "customer_name": "ACME GmbH", "invoice_date": "2025-07-01", "total_value": 123.45, "currency": "EUR",
    }
    assert len(got["docs/tic"]["extracted"]) == 12 and len(got["docs/pas.PDF"]["extracted"]) == 4
    assert "docs/ünï.pdf" in got and got["docs/ünï.pdf"]["errors"] is None


def test_csv_report(docs, tmp_path):
    odd = docs.withColumn("errors", F.when(F.col("path") == "docs/inv.pdf", 'a "quoted", one').otherwise(F.col("errors")))
    write_report(analyze(odd, options=OPTIONS), str(tmp_path / "report"))
    rows = [r for f in glob.glob(str(tmp_path / "report" / "part-*")) for r in csv.DictReader(open(f, encoding="utf-8", newline=""))]
    got = {r["path_in"]: r for r in rows}
    assert len(rows[0]) == 19
    assert got["docs/inv.pdf"]["errors"] == 'a "quoted", one' and got["docs/inv.pdf"]["total_value"] == "123.45"
    assert got["docs/tic"]["flight_number"] == "LH123" and got["docs/tic"]["surname"] == "" and got["docs/tic"]["path_out"] == ""


def test_no_report_without_results(docs, tmp_path):
    write_report(analyze(docs.limit(0), options=OPTIONS), str(tmp_path / "report"))
    assert not (tmp_path / "report").exists()


def test_report_has_the_fixed_columns(docs):
    from doctriage import fixed

    assert report_rows(analyze(docs, options=OPTIONS)).columns == fixed.REPORT_COLUMNS


# -- sources -----------------------------------------------------------------
@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in {"a.pdf": "x", "b.PDF": "y", "c.txt": "z", "sub/d.pdf": "w"}.items():
        (tmp_path / "in" / name).write_text(content)
    return str(tmp_path / "in")


def names(df):
    return sorted(r["path"].rsplit("/in/")[1] for r in df.select("path").collect())


def test_listing(spark, folder):
    assert names(list_documents(spark, folder)) == ["a.pdf", "b.PDF"]
    assert names(list_documents(spark, folder, recursive=True)) == ["a.pdf", "b.PDF", "sub/d.pdf"]
    assert names(list_documents(spark, folder + "/c.txt")) == ["c.txt"]
    assert names(list_documents(spark, folder, recursive=True, pattern="*")) == ["a.pdf", "b.PDF", "c.txt", "sub/d.pdf"]
    assert list_documents(spark, folder).collect()[0]["path"].startswith("/")


def test_listing_feeds_the_rename_plan(spark, folder):
    new = spark.createDataFrame([("q", f"{folder}/a.pdf")], "path_in string, target string")
    (row,) = plan_renames(new, list_documents(spark, folder, pattern="*")).collect()
    assert row["path_out"] == f"{folder}/a-1.pdf"


def test_text_files(spark, folder):
    rows = read_text_files(spark, folder, recursive=True, pattern="*.txt").collect()
    assert [(r["text"], r["errors"]) for r in rows] == [("z", None)]


def test_table_source(spark):
    df = spark.createDataFrame([(1, None, "bad")], "id int, body string, e string")
    (row,) = from_table(df, F.concat(F.lit("p"), "id"), "body", "e").collect()
    assert tuple(row) == ("p1", "", "bad")


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# -- streaming ---------------------------------------------------------------
def test_stream_picks_up_new_files_only(spark, tmp_path):
    source, out = tmp_path / "src", tmp_path / "out"
    source.mkdir()

    def run():
        write_json_stream(stream_text_files(spark, str(source)), str(out), "test", options=OPTIONS).awaitTermination()
        return sorted(json.loads(r["value"])["top_class"] for r in spark.read.text(str(out)).collect())

    (source / "a.txt").write_text(TEXTS["docs/inv.pdf"])
    assert run() == ["invoice"]
    (source / "b.txt").write_text(TEXTS["docs/pas.PDF"])
    assert run() == ["invoice", "passport"]


def test_results_of_a_stream_are_named_afterwards(spark, tmp_path):
    source, out = tmp_path / "src", tmp_path / "out"
    source.mkdir()
    for name in ("a.txt", "b.txt"):
        (source / name).write_text(TEXTS["docs/inv.pdf"])
    write_results_stream(stream_text_files(spark, str(source)), str(out), "results", options=OPTIONS, dest="/sorted").awaitTermination()
    results = spark.read.parquet(str(out))
    taken = spark.createDataFrame([(r.target,) for r in results.select("target").limit(1).collect()], "path string")
    got = sorted(r.path_out for r in with_renames(results, taken).collect())
    target = taken.first().path
    assert target.startswith("/sorted/Inv_INV-123_ACME GmbH_123.45_2025-07-01.")
    assert got == [target.replace("-01.txt", "-01-1.txt"), target.replace("-01.txt", "-01-2.txt")]
    with pytest.raises(ValueError):
        analyze(stream_text_files(spark, str(source)), rename=True, options=OPTIONS)


def test_results_are_stored_once_where_the_caller_says(spark, docs, tmp_path):
    results = store_results(analyze(docs, options=OPTIONS, dest="sorted"), str(tmp_path / "results"))
    renamed = with_renames(results)
    assert {r.path_in: r.path_out for r in renamed.collect()} == {
        r.path_in: r.path_out for r in analyze(docs, rename=True, dest="sorted", options=OPTIONS).collect()
    }
    moves = spark.createDataFrame([("docs/inv.pdf", "rename_error: denied"), ("docs/tic", None)], "path_in string, error string")
    errors = {r.path_in: r.errors for r in with_move_errors(renamed, moves).collect()}
    assert errors["docs/inv.pdf"] == "rename_error: denied" and errors["docs/tic"] is None and errors["docs/none.pdf"] == "load_error: x"


# -- plan shape and properties ------------------------------------------------
def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_analysis_is_one_narrow_stage_without_python(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    plan = physical(analyze(from_table(raw, F.col("doc_id").cast("string")), options=OPTIONS))
    for word in ("Exchange", "Join", "Python", "ArrowEval"):
        assert word not in plan
    schema = plan[plan.index("ReadSchema"):]
    assert "doc_id" in schema and "text" in schema and "n_chars" not in schema and "source" not in schema


def test_filters_pass_below_the_analysis(spark, tmp_path):
    given = spark.createDataFrame([("a", "b", "d1"), ("c", "é", "d2")], "path string, text string, day string")
    given.write.partitionBy("day").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = physical(analyze(docs, options=OPTIONS).filter("path_in = 'a'"))
    assert "EqualTo(path,a)" in plan and "java_method" not in plan
    scored = physical(classify(docs).filter("day = 'd1'"))
    assert "isnotnull(day" in scored[scored.index("PartitionFilters"):].split("]")[0]


def test_results_do_not_depend_on_partitioning(spark):
    texts = render.corpus(spark, SF)
    results = [
        {tuple(map(str, r)) for r in report_rows(analyze(texts.repartition(n, "path"), rename=True, options=OPTIONS)).collect()}
        for n in (1, 7)
    ]
    assert results[0] == results[1] and len(results[0]) == texts.count()


def test_spread_only_on_request(spark):
    few = spark.range(0, 10, 1, 1)
    assert spread(few, "id") is few
    assert spread(few, "id", 5).rdd.getNumPartitions() == 5


def test_paths_of_files_are_decoded(spark, tmp_path):
    names = ["a b%20ü.txt", "c+d.txt", "100%.txt", "plain.txt"]
    for name in names:
        (tmp_path / name).write_text("text")
    want = sorted(str(tmp_path / n) for n in names)
    assert sorted(r.path for r in read_text_files(spark, str(tmp_path)).collect()) == want
    assert sorted(r.path for r in list_documents(spark, str(tmp_path), pattern="*").collect()) == want


def test_normalize_is_idempotent(spark):
    norm = render.documents(spark, SF).select(normalize_text(F.col("text")).alias("n"))
    assert norm.filter(normalize_text(F.col("n")) != F.col("n")).count() == 0
