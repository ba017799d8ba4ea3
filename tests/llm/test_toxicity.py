"""The automaton against edit distances, and held-out accuracy."""

import random

from doctriage.llm import toxicity
from doctriage.llm.automaton import Lexicon


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matches_are_all_words_within_one_edit():
    rng = random.Random(4)
    terms = {"".join(rng.choices("abc", k=rng.randint(2, 8))): 1.0 for _ in range(40)}
    lexicon = Lexicon(terms, {})
    for _ in range(4000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        near = {t: d for t in terms if (d := _edits(word, t)) <= (1 if len(t) >= lexicon.fuzzy_from else 0)}
        got = lexicon.match(word)
        if near:
            assert got is not None and not got[2] and near[got[0]] == got[1] == min(near.values())
        else:
            assert got is None


def test_stems():
    lexicon = Lexicon({"idiot": 1.0}, {"lowei": 1.0, "lostra": 1.0})
    assert lexicon.match("loweischaft") == ("lowei", 0, True)
    assert lexicon.match("lowschaft") is None  # short stems have to be exact
    assert lexicon.match("lsotra") is None and lexicon.match("lostrra") == ("lostra", 1, True)
    assert lexicon.match("idiott") == ("idiot", 1, False) and lexicon.match("") is None


def test_context_tells_quotation_from_abuse():
    scanner = toxicity.Scanner({"idiot": 4.0}, {})
    factor = lambda text: [h[5] for h in scanner.hits(text)[0]]
    assert factor("you idiot") == [1.5] and factor("that idiot there") == [1.0]
    assert factor('the “idiot” of the novel') == [0.25] and factor("he said idiot twice") == [0.25]
    assert scanner.hits("An Idiott here")[0] == [("idiot", 3, 9, 1, False, 1.0)]
    assert scanner.hits("") == ([], 0)


def _corpus(n=600):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(800)]
    bad = ["grumpfel", "zorgwit", "bluxarg", "knorpat"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        text = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(toxic and rng.randint(2, 5)):
            word = rng.choice(bad)
            if rng.random() < 0.2:
                word = word[:3] + word[4:]
            text.insert(rng.randrange(len(text)), word)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t, _ in rows] + [(None, None, "x", 0.0), (9000, "", "x", 0.0), (9001, "mino " * 50_000, "x", 0.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    score = {r.doc_id: r.score for r in got}
    held = [(y, score[i] >= 0.5) for i, _, y in rows if i % 3 == 0]
    assert sum(y == p for y, p in held) / len(held) > 0.97
    assert len(got) == len(rows) + 3 and score[None] == score[9000] < 0.5 and score[9001] < 0.5
    same = docs.select("doc_id", toxicity.score_of(model, spark)("text").alias("s")).collect()
    assert all(abs(r.s - score[r.doc_id]) < 1e-12 for r in same)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5]


def test_sample_is_bounded(spark):
    rows = _corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_rows=300)
    assert {"grumpfel", "zorgwit"} <= model.terms.keys() | model.stems.keys()


def test_hits_weigh_by_spelling_and_context(spark):
    """The fitted model: misspelled abuse scores above clean text, quoted below plain, and every hit adds."""
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (model.weights[:-1] >= 0).all() and model.weights[:-1].max() > 0
    texts = {
        "clean": "mino leta rosu tirem salo", "plain": "mino zorgwit grumpfel tirem salo", "misspelled": "mino zorgwt grumfel tirem salo",
        "quoted": "mino “zorgwit grumpfel” tirem salo", "addressed": "you zorgwit grumpfel tirem salo", "one": "mino zorgwit leta tirem salo",
    }
    given = spark.createDataFrame([(n, t) for n, t in enumerate(texts.values())], "doc_id long, text string")
    score = dict(zip(texts, [r.score for r in sorted(toxicity.score(given, model).collect(), key=lambda r: r.doc_id)]))
    assert score["clean"] < score["misspelled"] < score["plain"] < score["addressed"]
    assert score["clean"] < score["quoted"] < score["plain"] and score["one"] < score["plain"]
    assert score["misspelled"] > 0.5


def test_words_like_a_term_in_clean_texts_count_less(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        text = rng.choices(["mino", "leta", "rosu", "salo"], k=30)
        text += ["grumpfel", "knorpat"] if toxic else (["knorpet"] if i % 4 == 1 else [])
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(model.terms) == {"grumpfel", "knorpat"} and model.near["knorpat"] < 0.1
    assert model.near.get("grumpfel", toxicity._MISSPELLED) > 0.7


def test_the_lexicon_has_no_words_of_a_few_texts(spark):
    """Words that only stand in one family of copies are not learned, however toxic it is."""
    rows = _corpus(1500)
    family = " ".join(f"odd{i}word" for i in range(40))
    rows += [(10_000 + i, f"{family} grumpfel v{i}", 1) for i in range(8)] + [(20_000 + i, family + " zorgwit same", 1) for i in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(model.terms) <= {"grumpfel", "zorgwit", "bluxarg", "knorpat"} | {w[:3] + w[4:] for w in ("grumpfel", "zorgwit", "bluxarg", "knorpat")}


def test_labels_that_contradict_each_other(spark):
    rows = _corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    both = spark.createDataFrame([(i, y) for i, _, y in rows for y in (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, both)
    assert model.terms == {} and model.stems == {}
    assert all(abs(r.score - 0.5) < 1e-6 for r in toxicity.score(docs, model).collect())
