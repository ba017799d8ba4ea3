import math
import random
import re

import pytest
from pyspark.sql import functions as F

from doctriage import Rules, classify, rule_hits, score_by_table
from doctriage.operators.classify import score, softmax
from doctriage.plans import queries
from doctriage.plans.analyze import extract

INVOICE = "Invoice No: R-2044\nBill To: Lindner KG\nAmount Due: € 2.410,75\n"
TICKET = "E-Ticket Itinerary\nPNR: ABC123\nFlight LH123 Boarding 10:20 Gate A12 Departure FRA Arrival LHR\n"
PASSPORT = "PASSPORT\nNationality: DEU\nGiven Names: MAX\nSurname: MUSTERMANN\nDate of Expiry: 2030-01-01\n"
PLAIN = "Nothing in these lines tells what they are about."


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def by_path(df):
    return {r["path"]: r for r in df.collect()}


def test_softmax(spark):
    row = spark.range(1).select(*softmax([F.lit(x) for x in (1.0, 2.0, 3.0)], 1.0)).collect()[0]
    assert [round(x, 4) for x in row] == [0.09, 0.2447, 0.6652]
    assert abs(sum(row) - 1) < 1e-9
    cold = spark.range(1).select(*softmax([F.lit(0.0), F.lit(1.0)], 0.0)).collect()[0]
    assert list(cold) == [0.0, 1.0]
    assert softmax([], 1.0) == []


def test_default_rules(spark):
    got = by_path(classify(docs(spark, INVOICE, TICKET, PASSPORT, PLAIN, None, "")))
    assert [got[str(i)]["top_class"] for i in range(6)] == ["invoice", "flight_ticket", "passport", "other", "other", "other"]
    assert [round(got[str(i)]["confidence"], 4) for i in range(6)] == [0.9926, 0.9998, 0.9802, 0.25, 0.25, 0.25]
    # Nothing found: uniform, the first class wins the tie, its probability is kept.
    assert got["3"]["raw_class"] == "invoice"
    for r in got.values():
        assert abs(sum(r["probabilities"].values()) - 1) < 1e-9


def test_scores_of_the_samples(spark):
    got = by_path(score(docs(spark, INVOICE, TICKET, PASSPORT), Rules.default()))
    assert [got["0"][f"_score_{i}"] for i in range(4)] == [6.0, 0.0, 0.0, 0.0]
    assert [got["1"][f"_score_{i}"] for i in range(4)] == [0.0, 9.5, 0.0, 0.0]
    assert [got["2"][f"_score_{i}"] for i in range(4)] == [0.0, 0.0, 5.0, 0.0]


def test_fuzzy_boost_is_half_a_point_and_optional(spark):
    d = docs(spark, "please see purchaze order twelve")
    assert by_path(score(d, Rules.default()))["0"]["_score_0"] == 0.5
    assert by_path(score(d, Rules.default(), fuzzy=False))["0"]["_score_0"] == 0.0


def test_keywords_are_substrings_of_the_normalised_text(spark):
    rules = Rules.from_dict({"a": {"keywords": ["VAT", "é"]}, "b": {"phrases": ["x y"]}})
    got = by_path(score(docs(spark, "Prívate  VAT", "X\n Y é"), rules, fuzzy=False))
    assert [got["0"]["_score_0"], got["1"]["_score_0"], got["1"]["_score_1"]] == [2.0, 0.0, 1.5]


def test_class_order_defaults_and_temperature():
    rules = Rules.from_dict({"receipt": {"keywords": ["shop"], "temperature": 6}, "passport": {}})
    assert rules.names == ["receipt", "passport", "invoice", "flight_ticket", "other"]
    assert rules.temperature == 2.0


def test_rules_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    f = tmp_path / "rules.yaml"
    f.write_text("receipt:\n  keywords: [till]\n  regexes:\n  - {pattern: 'a+', weight: '2'}\n  - {weight: 1}\n")
    rules = Rules.from_yaml(str(f))
    assert rules.classes[0].regexes == (("a+", 2.0),)
    f.write_text("receipt:\n  regexes:\n  - {pattern: 'a+', weight: heavy}\n")
    with pytest.raises(ValueError):
        Rules.from_yaml(str(f))
    f.write_text("")
    assert Rules.from_yaml(str(f)).names == ["invoice", "flight_ticket", "passport", "other"]


def test_invalid_patterns_are_skipped(spark):
    rules = Rules.from_dict({"a": {"regexes": [{"pattern": "(", "weight": 9}, {"pattern": "b", "weight": 2}]}})
    got = by_path(classify(docs(spark, "abb"), rules))["0"]
    assert got["raw_class"] == "a"
    assert math.isclose(got["probabilities"]["a"], math.exp(4) / (math.exp(4) + 4))


def test_custom_class_below_and_above_threshold(spark):
    rules = Rules.from_dict({"receipt": {"keywords": ["till"]}})
    got = by_path(classify(docs(spark, "till till till", "till"), rules))
    assert [got[str(i)]["top_class"] for i in range(2)] == ["receipt", "other"]
    assert got["1"]["raw_class"] == "receipt" and got["1"]["confidence"] < 0.6


def test_temperature_override(spark):
    got = [by_path(classify(docs(spark, INVOICE), temperature=t))["0"]["confidence"] for t in (None, 1.0, 3.0)]
    assert got[0] == got[1] > got[2]


def test_table_form_equals_unrolled_form(spark):
    d = docs(spark, INVOICE, TICKET, PASSPORT, PLAIN, "the vat of the vats", None)
    rules = Rules.from_dict({**queries.WORD_RULES, "flight_ticket": {"keywords": ["gate", ""]}})
    wide = by_path(score(d, rules, fuzzy=False))
    long = score_by_table(d, rules.to_table(spark)).collect()
    assert len(long) == 6 * len(rules.names)
    for r in long:
        assert r["score"] == wide[r["path"]][f"_score_{r['class_ord']}"]
    assert Rules.from_table(rules.to_table(spark)) == rules


def test_rule_hits(spark):
    got = {(r["kind"], r["pattern"]): (r["documents"], r["matches"]) for r in rule_hits(docs(spark, "vat vat", "VAT", "x"), Rules.default()).collect()}
    assert got[("keyword", "vat")] == (2, 3)
    assert got[("phrase", "tax")] == (0, 0)
    assert len(got) == 9 + 10 + 9 + 3 + 2 + 1 + 3


def test_table_form_equals_unrolled_form(spark):
    rng = random.Random(8)
    words = ["purchase order", "invoice", "tion", "itinerary", "boarding pass", "a", "total amount due now ok"]
    patterns = [r"(?P<q>a)b", "((", r"\d+", "[", r"(?P<x>x)(?P=x)", "total"]
    for _ in range(4):
        data = {
            f"c{i}": {
                "keywords": rng.sample(words, 3), "phrases": rng.sample(words, 2), "temperature": 2.0,
                "regexes": [{"pattern": p, "weight": rng.random()} for p in rng.sample(patterns, 3)],
            }
            for i in range(3)
        }
        rules = Rules.from_dict(data)
        texts = ["purchase ordr", "ab xx 12 Total", "", None, "iteneration itinerery", "boarding pss " * 3, "z" * 12_000 + " purchaze order"]
        d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
        wide = score(d, rules.usable(spark)).collect()
        want = {(r["path"], c): r[f"_score_{i}"] for r in wide for i, c in enumerate(rules.names)}
        long = {(r["path"], r["class"]): r["score"] for r in score_by_table(d, rules.to_table(spark)).collect()}
        assert long == want


def test_checking_patterns_runs_no_job(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    Rules.default().usable(spark)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)


def test_generated_methods_are_compiled(spark):
    """No generated method has over 8,000 bytes: the JVM interprets larger ones."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) AS path", "text")
    for df in (score(texts, queries.word_rules()), classify(texts), extract(classify(texts), queries.OPTIONS)):
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000
