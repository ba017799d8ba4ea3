"""JSON and report from one run of the plan, committed together."""

import json
import os

import pytest
from pyspark.sql import functions as F

from doctriage import analyze, write_report
from doctriage.plans import report
from doctriage.plans.report import write_outputs
from doctriage.streaming.incremental import stream_text_files, write_outputs_stream

TEXTS = ["Invoice No: A-1\nBill To: ACME\nTotal: 12,50 EUR\nInvoice Date: 01.02.2025", "nothing", "Passport\nSurname: DOE\nGiven Names: JO"]


def results(spark, counter=None):
    docs = spark.createDataFrame([(f"d/{i}.pdf", t, None) for i, t in enumerate(TEXTS)], "path string, text string, errors string")
    if counter is not None:
        docs = docs.withColumn("text", F.udf(lambda t: counter.add(1) or t)("text"))
    return analyze(docs)


def lines(folder):
    return sorted(line for f in os.listdir(folder) if f.startswith("part") for line in open(f"{folder}/{f}", encoding="utf-8"))


def test_both_forms_from_one_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    out = str(tmp_path / "out")
    assert write_outputs(results(spark, seen), out, run="r1")
    assert seen.value == len(TEXTS)
    assert sorted(json.loads(x)["path_in"] for x in lines(f"{out}/json")) == [f"d/{i}.pdf" for i in range(3)]
    rows = [x for x in lines(f"{out}/report") if x.startswith("d/")]
    assert len(rows) == 3 and os.listdir(tmp_path) == ["out"]


def test_a_run_is_done_once(spark, tmp_path):
    out = str(tmp_path / "out")
    assert write_outputs(results(spark), out, run="r1")
    before = {f: os.stat(f"{out}/json/{f}").st_mtime_ns for f in os.listdir(f"{out}/json")}
    assert not write_outputs(results(spark), out, run="r1")
    assert before == {f: os.stat(f"{out}/json/{f}").st_mtime_ns for f in os.listdir(f"{out}/json")}
    with pytest.raises(ValueError):
        write_outputs(results(spark), out, run="r2")


@pytest.mark.parametrize("step", ["write_json", "_write_csv", "move"])
def test_a_failed_run_leaves_nothing_and_is_repeated(spark, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(report, step, fail)
        with pytest.raises(RuntimeError):
            write_outputs(results(spark), out, run="r1")
        assert not os.path.exists(out)
    assert write_outputs(results(spark), out, run="r1")
    assert len(lines(f"{out}/json")) == 3 and os.listdir(tmp_path) == ["out"]


def test_no_results(spark, tmp_path):
    empty = results(spark).where("false")
    assert write_outputs(empty, str(tmp_path / "out"))
    assert lines(tmp_path / "out/json") == [] and os.listdir(tmp_path / "out/report") == []
    write_report(empty, str(tmp_path / "report"))
    assert os.listdir(tmp_path) == ["out"]


def test_report_runs_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    write_report(results(spark, seen), str(tmp_path / "report"))
    assert seen.value == len(TEXTS) and len([x for x in lines(tmp_path / "report") if x.startswith("d/")]) == 3


def test_stream_of_both_forms(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    out = str(tmp_path / "out")
    for batch in range(2):
        (tmp_path / "in" / f"{batch}.txt").write_text(TEXTS[batch])
        docs = stream_text_files(spark, str(tmp_path / "in"))
        write_outputs_stream(docs, out, f"both-{tmp_path.name}").awaitTermination()
    assert sorted(os.listdir(out)) == ["batch=0", "batch=1"]
    assert [len(lines(f"{out}/batch={i}/json")) for i in range(2)] == [1, 1]
