"""Scalars: text, regex, dates, amounts, times, names."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from doctriage.functions import amounts, dates, names, regex, text

AS_OF = dt.date(2026, 12, 1)


def test_normalize_text(evaluate):
    given = ["A\n\t b  c\x1c d", "Ünïcödé ﬁ ½", None, "", " \r\n ", "x y z", "İSTANBUL ΟΔΟΣ", "한글"]
    assert evaluate(given, text.normalize_text) == [
        "a b c d", "unicode fi 1⁄2", "", "", "", "x y z", "istanbul οδος", unicodedata.normalize("NFKD", "한글"),
    ]


def test_every_character_is_decomposed_as_by_definition(spark):
    chars = [(c, "a" + chr(c) + "b") for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame(chars, "c int, v string")
    got = dict(df.select("c", text.strip_accents(F.col("v"))).collect())
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    assert [c for c, v in chars if got[c] != plain(v)] == []


def test_mixed_texts_are_decomposed(evaluate):
    given = ["ﬁ한글é½", "", "ﬀﬀ", "x" * 50 + "㎒" + "각", "e\u0323\u0301 ǅ", "½"]
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    assert evaluate(given, text.strip_accents) == [plain(g) for g in given]


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(1)
    values = [1.005, 2.675, 0.125, 0.375, 0.995, 1e13 + 0.3, 123456789012.345, 98765432109.125, 0.0, 12345.6785, 99.995, 0.00005, 0.12345, -1.005, 2.5e-9]
    values += [rng.randint(0, 10**7) / 1000 for _ in range(500)] + [rng.randint(0, 10**6) / 8 for _ in range(200)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.select("i", amounts.fixed_point(F.col("v")).alias("t"), amounts.rounded(F.col("v")).alias("r")).collect()
    got = {r.i: (r.t, r.r) for r in rows}
    assert [(v, got[i]) for i, v in enumerate(values) if got[i] != ("%.2f" % v, round(v, 4))] == []


def test_spellings_of_a_path(evaluate):
    given = ["a//b/./c", "./x", "s3a://bucket//k", "file:///a//b", "//x", "a/../b", "././y", ".", "./"]
    want = ["a/b/c", "x", "s3a://bucket/k", "file:///a/b", "/x", "a/../b", "y", ".", "./"]
    assert evaluate(given, text.normalized_path) == want


def test_collapse_spaces_equals_split_and_join(evaluate):
    rng = random.Random(7)
    spaces = [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　"]
    given = ["".join(rng.choice(spaces + ["a", "é", "ß", "z"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert evaluate(given, text.collapse_spaces) == [" ".join(g.split()) for g in given]


def test_count_literal(evaluate):
    given = ["private vat VAT", "aaaa", "", "né né"]
    assert evaluate(given, lambda c: text.count_literal(c, "vat")) == [2.0 - 0, 0.0, 0.0, 0.0]
    assert evaluate(given, lambda c: text.count_literal(c, "aa")) == [0.0, 2.0, 0.0, 0.0]
    assert evaluate(given, lambda c: text.count_literal(c, "né")) == [0.0, 0.0, 0.0, 2.0]
    assert evaluate(given, lambda c: text.count_literal(c, "")) == [16.0, 5.0, 1.0, 6.0]


def test_count_matches_is_case_insensitive_and_unicode(evaluate):
    assert evaluate(["PNR: abc12", "pnr ÀBC12", "none"], lambda c: regex.count_matches(c, r"PNR\s*[:#]?\s*[A-Z0-9]{5,7}")) == [1, 0, 0]
    assert evaluate(["ÉTÉ été", "x"], lambda c: regex.count_matches(c, r"\bété\b")) == [2, 0]


def test_named_groups_are_understood(evaluate):
    assert evaluate(["aXXb"], lambda c: regex.count_matches(c, r"(?P<x>x)(?P=x)")) == [1]


@pytest.mark.parametrize("pattern", [r"\d+", r"(?<![A-Z])[A-Z]{2}/(\d)", r"(?i)b\s*é?"])
def test_find_matches_equals_finditer(evaluate, pattern):
    rng = random.Random(5)
    given = ["".join(rng.choice("ab 12/é\nAB") for _ in range(rng.choice([0, 3, 50, 3000]))) for _ in range(12)]
    got = evaluate(given, lambda c: regex.find_matches(c, pattern, before=7, after=5))
    for g, found in zip(given, got):
        want = [
            (m.start(), m.group(), g[max(0, m.start() - 7): m.start()], g[m.end(): m.end() + 5])
            for m in re.finditer(pattern, g)
        ]
        assert [tuple(f) for f in found] == want


def test_find_matches_of_null_is_null(evaluate):
    assert evaluate([None], lambda c: regex.find_matches(c, "a")) == [None]


def test_first_groups(evaluate):
    got = evaluate(["a1 b2", "zz"], lambda c: regex.first_groups(c, r"([a-z])(\d)", letter=1, digit=2))
    assert got[0].asDict() == {"letter": "a", "digit": "1"} and got[1] is None


def test_sanitize_filename(evaluate):
    given = ['Inv:001/"Acme"?*.pdf', " . dots. ", None, "x" * 200, "a\tb", "a   b", "é" * 181]
    assert evaluate(given, text.sanitize_filename) == [
        "Inv_001__Acme___.pdf", "dots", "", "x" * 180, "a_b", "a b", "é" * 180,
    ]


def test_merge_errors(evaluate):
    got = evaluate(["a", "", None], lambda c: text.merge_errors(c, F.lit(None).cast("string"), F.lit("b")))
    assert got == ["a | b", "b", "b"]
    assert evaluate(["", None], lambda c: text.merge_errors(c, c)) == [None, None]


def test_number_text(evaluate):
    got = evaluate([2345.67, 1000.0, 12345678.9, 1e9, 0.0, None], text.number_text, "i int, v double")
    assert got == ["2345.67", "1000.0", "12345678.9", "1000000000.0", "0.0", None]


# -- dates -------------------------------------------------------------------
DATES = {
    "12/08/2025": "2025-08-12",
    "08/25/2025": "2025-08-25",
    "13/13/2025": None,
    "31.02.2025": None,
    "01/02/75": "2075-02-01",
    "01/02/77": "1977-02-01",
    "99-01-02": "1999-02-01",
    "12-08/2025": "2025-08-12",
    "12.08/2025": None,
    "Mar 5, 25": "2025-03-05",
    "5 SEPT 2025": "2025-09-05",
    "32 Mar 25": "2032-03-25",
    "32 Mar 2025": None,
    "1/2/202": "202-02-01",
    "Mai 3 2025": None,
    "2025-07-01": None,
    "": None,
    None: None,
}


def test_parse_date(evaluate):
    assert evaluate(list(DATES), lambda c: dates.parse_date(c, AS_OF)) == list(DATES.values())
    assert evaluate(["2025-07-01", "2025-13-01"], lambda c: dates.parse_date(c, AS_OF, True)) == ["2025-07-01", None]


def test_parse_date_against_dateutil(evaluate):
    parser = pytest.importorskip("dateutil.parser")
    if dt.date.today().year // 100 != 20 or not 2025 <= dt.date.today().year <= 2027:
        pytest.skip("dateutil takes the century window from the clock")
    today = dt.datetime.combine(AS_OF.replace(year=dt.date.today().year), dt.time())

    def reference(s):
        try:
            return parser.parse(s, dayfirst=True, yearfirst=False, fuzzy=True, default=today).strftime("%Y-%m-%d")
        except Exception:
            return None

    rng = random.Random(11)
    months = ["Jan", "feb", "MARCH", "April", "May", "june", "Jul", "AUG", "Sept", "October", "Nov", "december"]
    given = []
    for _ in range(1500):
        a, b = (str(rng.choice([rng.randint(0, 14), rng.randint(0, 40), rng.randint(0, 99)])) for _ in range(2))
        y = rng.choice([f"{rng.randint(0, 99):02d}", str(rng.randint(1900, 2100)), f"{rng.randint(0, 999):03d}"])
        m = rng.choice(months)
        given += [a + rng.choice("./-") + b + rng.choice("./-") + y, f"{a} {m} {y}", f"{m} {a}, {y}"]
    got = evaluate(given, lambda c: dates.parse_date(c, today.date()))
    assert [(g, x) for g, x in zip(given, got) if x != reference(g)] == []


def test_parse_day_month(evaluate):
    given = ["02JUN", "2 Sept", "31FEB", "29FEB", "45JAN", "02XXX", "02JUN2025", "00JAN"]
    assert evaluate(given, lambda c: dates.parse_day_month(c, AS_OF)) == [
        "2026-06-02", "2026-09-02", None, None, "2045-01-01", None, None, None,
    ]
    # A year without a day takes the day of as_of, or the last of the month.
    assert evaluate(["40FEB", "41FEB"], lambda c: dates.parse_day_month(c, dt.date(2026, 12, 31))) == [
        "2040-02-29", "2041-02-28",
    ]


# -- amounts and times -------------------------------------------------------
AMOUNTS = {
    "123": 123.0, "2,345": 2.345, "1.234.567": 1234.567, "1,234,567": None, "1,234,567.89": 1234567.89,
    "1.234,56": 1234.56, " 12 345,60 ": 12345.6, "1.234,567,89": None, "1.2.3.4": 123.4, "": None, "x": None, None: None,
}


def test_parse_amount(evaluate):
    assert evaluate(list(AMOUNTS), amounts.parse_amount) == list(AMOUNTS.values())


def test_currency_code(evaluate):
    assert evaluate(["usd", "", None], lambda c: amounts.currency_code(c, F.lit("€\xa0"))) == ["USD", "EUR", "EUR"]
    assert evaluate(["", ""], lambda c: amounts.currency_code(c, F.lit("₿"))) == [None, None]


def test_normalize_time(evaluate):
    given = ["1 05 pm", "12 00 AM", "12 30 pm", "29 59 ", "7 5 "]
    got = evaluate(given, lambda c: amounts.normalize_time(*[F.split(c, " ")[i] for i in range(3)]))
    assert got == ["13:05", "00:00", "12:30", "29:59", "07:05"]


# -- names -------------------------------------------------------------------
def test_title_case(evaluate):
    cases = {
        "MCDONALD-O'NEIL": "McDonald O'Neil", "al'amin": "Al'Amin", "o'brien": "O'Brien", "D'ANGELO x": "D'Angelo X",
        "MC": "Mc", "mc'x": "Mc'X", "o'mcdonald": "O'Mcdonald", "jean--mc donald": "Jean Mc Donald", "mcmahon": "McMahon", "": "",
    }
    assert evaluate(list(cases), names.title_case) == list(cases.values())


def test_titles(evaluate):
    assert evaluate(["TAREKMR", "ADAMS", "JOHNMSTR.", "ALI"], names.strip_glued_title) == ["TAREK", "ADA", "JOHN", "ALI"]
    assert evaluate(["A B (MR)", "A ( dr ) ", "A (ADT)"], names.strip_parenthesised_title) == ["A B", "A", "A (ADT)"]
    assert evaluate(["DOE"], lambda c: names.full_name(F.lit(""), c)) == ["Doe"]


def test_looks_like_name(evaluate):
    cases = {
        "John Doe": True, "J Doe": False, "John": False, "A B C D E": False, "Ann Lee Kay Poe": True, "John May": False,
        "Viewer Agent": False, "John D0e": False, " ,John Doe, ": True, "Jo O'": False, "Jose Müller": False, "By Air": False,
        "X" * 50 + " " + "Y" * 40: False, "": False,
    }
    assert evaluate(list(cases), names.looks_like_name) == list(cases.values())


def test_a_date_is_written_once_and_searched_once(spark):
    """Expressions of the value appear once however many parts of it are read."""
    from datetime import date

    from doctriage.functions.dates import parse_date

    df = spark.createDataFrame([("31.12.2025",), ("1/2/25\n",), ("1\n2",), (None,)], "v string")
    parsed = df.select(parse_date(F.reverse(F.reverse("v")), date(2026, 12, 1)).alias("iso"))
    assert [r["iso"] for r in parsed.collect()] == ["2025-12-31", "2025-02-01", None, None]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1
