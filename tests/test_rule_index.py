"""Scores by the inverted index: equal to the unrolled form and to a plain count."""

import random
import time

import pytest

from doctriage.functions.text import normalize_text
from doctriage.operators.classify import score_by_table
from doctriage.functions import multi
from doctriage.operators import rule_index as index_module
from doctriage.operators.rule_index import literal_rules, rule_index, score_by_index
from doctriage.plans import queries
from doctriage.sources.rules import Rules


def by_class(df):
    return sorted((r["path"], r["class_ord"], r["class"], r["score"]) for r in df.collect())


def test_equals_the_unrolled_form_on_given_texts(spark):
    texts = queries.all_texts(spark, "/root/testdata/sf0.001")
    rules = {
        **queries.WORD_RULES,
        "invoice": {"keywords": ["gate", "en", "en", "number of the", "é"], "phrases": ["on", "  "], "regexes": [{"pattern": "(", "weight": 3}, {"pattern": "t.e", "weight": 0.1}]},
    }
    table = Rules.from_dict(rules).to_table(spark)
    assert by_class(score_by_index(texts, table)) == by_class(score_by_table(texts, table))


@pytest.mark.parametrize("seed", range(3))
def test_edited_keywords_and_tiny_texts(spark, seed):
    """Texts made of keywords with edits, and texts as short as the keywords; keywords of 20, 21 and more letters too."""
    rng = random.Random(seed)
    letters = "abcde" if seed else "abcdefghijklmnopqrstuvwxyz é.(+"
    words = ["".join(rng.choices(letters, k=n)).strip() or "a" for n in (1, 2, 3, 5, 6, 7, 10, 11, 12, 15, 20, 21, 22, 31)]

    def edited(word):
        w = list(word)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and w:
                del w[min(at, len(w) - 1)]
            else:
                w.insert(at, rng.choice(letters))
        return "".join(w)

    texts = [None, "", " ", *words, *(w[1:] for w in words), *(edited(w) for w in words * 3)]
    texts += [f"xyz zyx {edited(w)} zzz" for w in words * 4] + [f"{edited(w)} qq {edited(v)}" for w in words for v in words[-4:]]
    rules = Rules.from_dict({"a": {"keywords": words[::2], "phrases": words[:3]}, "b": {"keywords": [*words[1::2], ""], "phrases": [""]}})
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("0", "again"), ("0", "again")], "path string, text string")
    table = rules.to_table(spark)
    assert by_class(score_by_index(df, table)) == by_class(score_by_table(df, table))
    assert by_class(score_by_index(df, table, fuzzy=False)) == by_class(score_by_table(df, table, fuzzy=False))


def test_five_thousand_rules(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnop ", k=rng.randint(3, 14))).strip() for _ in range(6000)} - {""})[:5000]
    classes = {f"c{i}": {"keywords": words[i::10], "phrases": [w + "s" for w in words[i::50]]} for i in range(10)}
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    table = Rules.from_dict(classes).to_table(spark)
    started = time.time()
    scored = score_by_index(df, table, fuzzy=False)
    scored._jdf.queryExecution().executedPlan()
    assert time.time() - started < 5
    got = {(r["path"], r["class"]): r["score"] for r in scored.collect()}
    norms = {r["path"]: r["norm"] for r in df.select("path", normalize_text(df.text).alias("norm")).collect()}
    for path, norm in norms.items():
        for name, c in classes.items():
            want = sum(norm.count(k) for k in c["keywords"]) + 1.5 * sum(norm.count(p) for p in c["phrases"])
            assert got[path, name] == want
    assert len(got) == 60 * 14


def test_index_lists_each_literal_few_times(spark):
    table = Rules.from_dict({"a": {"keywords": ["invoice number", "gate", "to"], "phrases": ["boarding pass"]}}).to_table(spark)
    literals = literal_rules(table)
    listed = {}
    words = {r["rule"]: r["word"] for r in literals.collect()}
    for r in rule_index(literals).collect():
        listed.setdefault(words[r["rule"]], set()).add(r["gram"])
    assert listed["to"] == {"to"} and len(listed["gate"]) == 1 and len(listed["boarding pass"]) == 1
    assert 3 <= len(listed["invoice number"]) <= 7


def test_no_pair_of_document_and_rule_without_a_gram(spark):
    df = spark.createDataFrame([("a", "gate"), ("b", "x")], "path string, text string")
    table = Rules.from_dict({"a": {"keywords": ["seat"]}}).to_table(spark)
    plan = score_by_index(df, table, fuzzy=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner, (gram" in plan
    assert by_class(score_by_index(df.where("false"), table)) == []


def test_keywords_around_the_pattern_limit_on_given_texts(spark):
    """Keywords of 19 to 22 letters cut from the given texts, one letter changed: patterns (up to 20) and windows (beyond, and in the index) agree."""
    texts = queries.all_texts(spark, "/root/testdata/sf0.001")
    norms = [r["norm"] for r in texts.select(normalize_text(texts.text).alias("norm")).orderBy("path").limit(60).collect()]
    rng = random.Random(1)
    keywords = []
    for n, size in zip(norms, [19, 20, 21, 22] * 15):
        if len(n) > 60:
            at = rng.randrange(len(n) - 30)
            word = n[at : at + size]
            keywords.append(word[:7] + "q" + word[8:])
    table = Rules.from_dict({"a": {"keywords": keywords[:12]}, "b": {"keywords": keywords[12:24]}}).to_table(spark)
    unrolled, indexed = by_class(score_by_table(texts, table)), by_class(score_by_index(texts, table))
    assert unrolled == indexed and sum(r[3] for r in unrolled) > 5


def test_neither_texts_nor_pairs_are_shuffled(spark):
    """Every text holds every word: what is shuffled are sums, a row for each document and task."""
    words = [f"word{i}x" for i in range(60)]
    df = spark.createDataFrame([(str(i), " ".join(words)) for i in range(50)] * 2, "path string, text string")
    table = Rules.from_dict({"a": {"keywords": words}}).to_table(spark)
    scored = score_by_index(df, table, fuzzy=False)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Distinct" not in plan and plan.count("Aggregate") == 1
    assert plan.count("Join LeftOuter") == plan.count("Join Inner") == 1
    got = [r["score"] for r in scored.where("class = 'a'").collect()]
    assert got == [60.0] * 100


def test_only_grams_of_the_index_are_looked_up(spark, monkeypatch):
    """A text is not cut into all its stretches while one pattern, or a few searches, can find what is listed; the ways agree."""
    rng = random.Random(9)
    words = ["gate", "gat", "ga", "that the an", "aabaabaabaab", "(x+", "é漢😀"]
    texts = [None, "", "\n", "ga", *["".join(rng.choices(["gate", "ga", " ", "that the", " an", "aab", "b", "(x+", "é漢😀", "z"], k=25)) for _ in range(60)]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    table = Rules.from_dict({"a": {"keywords": words[::2], "phrases": words}, "b": {"keywords": words[1::2]}}).to_table(spark)
    stretches = "(?s)(?=(.{4}))"
    want = by_class(score_by_table(df, table))
    assert sum(r[3] for r in want) > 100
    for grams, few in ((10_000, 64), (10_000, 0), (3, 64)):
        monkeypatch.setattr(index_module, "LISTED_GRAMS", grams)
        monkeypatch.setattr(multi, "FEW", few)
        scored = score_by_index(df, table, fuzzy=False)
        # Tiny texts, with near matches only, have their grams looked up in any case.
        assert (stretches in scored._jdf.queryExecution().optimizedPlan().toString()) == (grams == 3)
        assert by_class(scored) == by_class(score_by_table(df, table, fuzzy=False))
        assert by_class(score_by_index(df, table)) == want


def test_windows_at_the_ends_of_a_text_and_over_line_ends(spark):
    """Windows are cut from a text with something around it that is no part of it, even if a keyword holds that."""
    words = ["purchase order", "issuing\nauthority", "\n\n\nabcdefghijklm", "just twenty one chars", "x\ny" * 7]
    texts = ["purchaze order", "zz purchase orde", "urchase order zz", "purchase  ordr", "issuing authority", "z issuin authority", "abcdefghijklm", "abcdefghijkl", "ust twenty one char and", "so just twentyone charz", "xyxyxyxyxyxyxy", "x y" * 7]
    df = spark.createDataFrame([(f"{i}-{j}", around[0] + t + around[1]) for i, t in enumerate(texts) for j, around in enumerate((("", ""), ("a", ""), ("", "a"), ("long " * 9, " long" * 9)))], "path string, text string")
    table = Rules.from_dict({"a": {"keywords": words[:2]}, "b": {"keywords": words[2:]}}).to_table(spark)
    want = by_class(score_by_table(df, table))
    assert by_class(score_by_index(df, table)) == want and sum(r[3] > 0 for r in want) > 10


@pytest.mark.parametrize("seed", range(2))
def test_words_are_counted_in_one_walk(spark, seed):
    """Words that begin with each other, overlap each other and themselves; one of over 64 characters and one of no letters beside them."""
    rng = random.Random(seed)
    letters = "ab" if seed else "ab.é😀 "
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))).strip() for _ in range(400)} - {""})[:150] + ["aaaa", "a" * 70]
    rules = Rules.from_dict({"x": {"keywords": words[::2], "phrases": words[::3]}, "y": {"keywords": [*words[1::2], *words[:20]], "regexes": [{"pattern": "a+", "weight": 1.5}]}})
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(40)] + [None, "", "a" * 500, "ab" * 200, "q"]
    df = spark.createDataFrame([(str(i % 40), t) for i, t in enumerate([*texts, texts[3], texts[42]])], "path string, text string")
    assert len(words) > multi.FEW
    for table in (rules.to_table(spark), Rules.from_dict({"x": {"keywords": words[::2] + [""]}, "y": {"keywords": words}}).to_table(spark)):
        assert by_class(score_by_index(df, table, fuzzy=False)) == by_class(score_by_table(df, table, fuzzy=False))


def test_no_text_is_searched_for_each_word(spark):
    words = [f"w{i:03d}x" for i in range(100)]
    table = Rules.from_dict({"x": {"keywords": words}}).to_table(spark)
    df = spark.createDataFrame([("a", "w001x w001xw002x"), ("b", "none")], "path string, text string")
    scores = score_by_index(df, table, fuzzy=False)
    assert "contains(norm" not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert {r["path"]: r["score"] for r in scores.where("class = 'x'").collect()} == {"a": 3.0, "b": 0.0}
