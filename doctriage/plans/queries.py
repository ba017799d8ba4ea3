"""Every registered query: an operator or a plan over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions import amounts, dates, names, text
from doctriage.functions.fuzzy import has_near_match
from doctriage.functions.regex import count_matches, find_matches
from doctriage.operators import naming, ticket
from doctriage.operators.classify import classify, probabilities_by_row, rule_hits, score, score_by_table, top_by_row
from doctriage.operators.invoice import ExtractOptions, extract_invoice
from doctriage.operators.passport import extract_passport
from doctriage.operators.rename import plan_renames
from doctriage.operators.rule_index import score_by_index
from doctriage.operators.ticket import candidate_rows, with_carrier, with_passenger_name, with_ticket
from doctriage.plans import render
from doctriage.plans.analyze import EXTRACTORS, analyze, extract, rounded
from doctriage.plans.report import report_rows, result_json
from doctriage.sources.corpus import balanced, from_table, list_documents
from doctriage.sources.listing import list_files
from doctriage.sources.rules import Rules

AS_OF = dt.date(2026, 12, 1)
OPTIONS = ExtractOptions(as_of=AS_OF)

# Rules whose words are frequent in the test texts, so that scores vary.  The
# class names show that rules are data: two are not built in.
WORD_RULES = {
    "english": {
        # The longer ones have near matches in the texts.
        "keywords": ["the", "and", "tion", "that the an", "in the ander"],
        "phrases": ["of the", "in the"],
        "regexes": [{"pattern": r"th[aeiou]+n", "weight": 0.5}],
        "temperature": 60.0,
    },
    "romance": {
        "keywords": ["que", "ción", "cion", "ment", "de la mente"],
        "phrases": ["de la", "les "],
        "regexes": [{"pattern": r"(de|la|el)\s+[a-z]{4,}", "weight": 1.5}],
        "temperature": 60.0,
    },
    "invoice": {"keywords": ["gate", "en"], "phrases": ["on"], "regexes": [], "temperature": 30.0},
    "other": {"keywords": ["seat"], "phrases": [], "regexes": [{"pattern": r"[0-9]{3,}"}], "temperature": 90.0},
}
COUNTED_WORDS = ["the", "en", "tion", "gate", "seat", "aa"]
COUNTED_PATTERNS = [r"th[aeiou]+n", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", r"(the|and)\s+[a-z]{2,}", r"[^ ]+@[^ ]+"]
FUZZY_WORDS = [
    "that the an", "the and the", "ther and the", "tion and the", "in the ander", "ing the andes", "de la mente",
    "es and tion", "andthe",
]
MATCH_PATTERN = r"[0-9]{2,}"


def word_rules() -> Rules:
    return Rules.from_dict(WORD_RULES)


def all_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of documents, pages and conversation turns."""
    return (
        render.documents(spark, sf)
        .select("path", "text")
        .unionByName(render.pages(spark, sf).select("path", "text"))
        .unionByName(render.turns(spark, sf))
    )


# -- sources -----------------------------------------------------------------
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = from_table(
        render.table(spark, sf, "documents"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".pdf"))
    )
    return docs.select("path", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "errors")


def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the given tables as executors list them, against the driver's listing: a row per table, and how many files only one of both has."""
    pattern = "*.parquet"
    ours = list_files(spark, sf, recursive=True, pattern=pattern).where("length > 0").select("path", F.lit(1).alias("a"))
    theirs = list_documents(spark, sf, recursive=True, pattern=pattern).select("path", F.lit(1).alias("b"))
    both = ours.join(theirs, "path", "full").withColumn("table", F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/|$)", 1))
    return both.groupBy("table").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("differing"))


def error_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = render.table(spark, sf, "documents").select("doc_id", "lang", "source")
    load = F.when(F.col("lang") == "de", F.concat(F.lit("load_error: "), "source"))
    ocr = F.when(F.col("lang") == "fr", F.lit("")).when(F.col("doc_id") % 3 == 0, F.lit("ocr_error: blank"))
    rename = F.when(F.col("doc_id") % 5 == 0, F.lit("rename_error: denied"))
    return d.select("doc_id", text.merge_errors(load, ocr, rename).alias("errors"))


def rules_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rules to a table and back, then the hits of every rule in all texts."""
    rules = Rules.from_table(word_rules().to_table(spark))
    return rule_hits(all_texts(spark, sf), rules)


# -- text --------------------------------------------------------------------
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return all_texts(spark, sf).select("path", text.normalize_text(F.col("text")).alias("norm"))


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    norm = normalize_text(spark, sf)
    counts = [text.count_literal(F.col("norm"), w).cast("bigint").alias(f"n_{w}") for w in COUNTED_WORDS]
    return norm.select("path", *counts)


def regex_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [
        count_matches(F.col("text"), p).cast("bigint").alias(f"n_{i}") for i, p in enumerate(COUNTED_PATTERNS)
    ]
    return all_texts(spark, sf).select("path", *counts)


def fuzzy_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Boost of every document per word: 0.5 without the word but with a near match."""
    norm = normalize_text(spark, sf)
    boosts = [
        F.when(F.contains("norm", F.lit(w)), 0.0)
        .when(has_near_match(F.col("norm"), w), fixed.FUZZY_BOOST)
        .otherwise(0.0)
        .alias("b_" + w.replace(" ", "_"))
        for w in FUZZY_WORDS
    ]
    return norm.select("path", *boosts)


def name_scalars(spark: SparkSession, sf: str) -> DataFrame:
    c = render.table(spark, sf, "customer").select("c_custkey")
    code = render.letters(F.col("c_custkey"))
    kind = F.col("c_custkey") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("MC"), code))
        .when(kind == 1, F.concat(F.lit("O'"), code))
        .when(kind == 2, F.concat(F.lit("D'"), code, F.lit("-X"), code))
        .when(kind == 3, F.concat(F.lit("Q"), code, F.lit("  mc'"), code))
        .otherwise(F.concat(F.lit("q"), code, F.lit("'z"), code))
    )
    glued = F.concat(F.lit("Q"), code, F.when(kind < 2, "MRS").when(kind < 4, "Mr.").otherwise("X"))
    marked = F.concat(F.lit("Q"), code, F.when(kind < 3, " ( Dr ) ").otherwise(" (Du)"))
    return c.select(
        "c_custkey",
        names.title_case(raw).alias("titled"),
        names.full_name(code, raw).alias("full_name"),
        names.strip_glued_title(glued).alias("unglued"),
        names.strip_parenthesised_title(marked).alias("unmarked"),
    )


def plausible_names(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments between punctuation that could be a name, per text."""
    fragments = F.filter(F.split("text", "[.,;:\n]"), names.looks_like_name)
    return all_texts(spark, sf).select("path", F.size(fragments).cast("bigint").alias("n_plausible"))


def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    urls = render.table(spark, sf, "pages").select(F.col("url").alias("name"))
    raw = all_texts(spark, sf).select(F.col("text").alias("name")).unionByName(urls)
    return raw.select(text.sanitize_filename(F.col("name")).alias("clean"))


def find_all_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = find_matches(F.col("text"), MATCH_PATTERN, before=12, after=12)
    return (
        all_texts(spark, sf)
        .select("path", F.inline(found))
        .select("path", F.col("start").cast("bigint").alias("start"), "match", "before", "after")
    )


# -- classification ----------------------------------------------------------
def score_wide(spark: SparkSession, sf: str) -> DataFrame:
    rules = word_rules()
    scored = score(all_texts(spark, sf), rules)
    return scored.select("path", *[F.col(f"_score_{i}").alias(f"s_{c}") for i, c in enumerate(rules.names)])


def score_long(spark: SparkSession, sf: str) -> DataFrame:
    return score_by_table(all_texts(spark, sf), word_rules().to_table(spark)).select("path", "class", "score")


def score_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores by the inverted index of the rules table."""
    return score_by_index(all_texts(spark, sf), word_rules().to_table(spark)).select("path", "class", "score")


def score_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the benchmark items, four letters or more, is a keyword of one of five classes."""
    items = render.table(spark, sf, "benchmark").select(
        F.concat(F.lit("c"), F.col("item_id") % 5).alias("class"), (F.col("item_id") % 5).cast("int").alias("class_ord"),
        F.explode(F.split(text.normalize_text(F.col("text")), " ")).alias("pattern"),
    )
    rules = items.where(F.length("pattern") >= 4).distinct().select(
        "class", "class_ord", F.lit("keyword").alias("kind"), "pattern", F.lit(fixed.KEYWORD_WEIGHT).alias("weight"), F.lit(None).cast("double").alias("temperature")
    )
    return score_by_index(all_texts(spark, sf), rules, fuzzy=False).select("path", "class", "score")


def _probable(spark: SparkSession, sf: str) -> DataFrame:
    rules = word_rules()
    return probabilities_by_row(score_by_table(all_texts(spark, sf), rules.to_table(spark)), temperature=rules.temperature)


def softmax_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities as windows over a document's rows."""
    return _probable(spark, sf).select("path", "class", rounded(F.col("probability")).alias("probability"))


def top_class_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The top class as a rank over a document's rows."""
    return top_by_row(_probable(spark, sf)).select("path", "raw_class", "top_class", rounded(F.col("confidence")).alias("confidence"))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify(all_texts(spark, sf), word_rules())


def softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    probs = [rounded(F.col("probabilities")[c]).alias(f"p_{c}") for c in word_rules().names]
    return _classified(spark, sf).select("path", *probs)


def top_class(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select(
        "path", "raw_class", "top_class", rounded(F.col("confidence")).alias("confidence")
    )


def route_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All given texts under the default rules, boost included, and what is extracted for them."""
    routed = extract(classify(all_texts(spark, sf)), OPTIONS)
    return routed.select(
        "path",
        "raw_class",
        "top_class",
        rounded(F.col("confidence")).alias("confidence"),
        *[F.col(c).isNotNull().alias(f"has_{c}") for c in EXTRACTORS],
    )


# -- dates, times, amounts ---------------------------------------------------
def _dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = balanced(render.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


DATE_FORMATS = ["dd.MM.yyyy", "d/M/yyyy", "dd-MM-yy", "MMMM d, yyyy", "d MMM yy", "MMM dd yyyy", "yyyy-MM-dd"]


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every order date in a format that depends on its key; the last one is not understood."""
    day, n = F.col("day"), len(DATE_FORMATS)
    written = F.coalesce(
        *[F.when(F.col("o_orderkey") % n == i, F.date_format(day, f)) for i, f in enumerate(DATE_FORMATS)]
    )
    us = F.date_format(day, "M/d/yyyy")
    return _dated_orders(spark, sf).select(
        "o_orderkey",
        dates.parse_date(written, AS_OF).alias("iso"),
        dates.parse_date(us, AS_OF).alias("iso_us"),
        dates.parse_date(F.date_format(day, "yyyy-MM-dd"), AS_OF, iso_dates=True).alias("iso_opt_in"),
        dates.parse_date(F.concat(F.lit("31.02."), F.year(day)), AS_OF).alias("impossible"),
    )


def day_month_tokens(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("day")
    glued = F.upper(F.date_format(day, "ddMMM"))
    return _dated_orders(spark, sf).select(
        "o_orderkey",
        dates.parse_day_month(F.replace(glued, F.lit("SEP"), F.lit("SEPT")), AS_OF).alias("glued"),
        dates.parse_day_month(F.date_format(day, "d MMM"), AS_OF).alias("spaced"),
    )


def normalize_times(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    half = F.when(F.hour(ts) < 12, "am").otherwise("PM")
    return (
        render.table(spark, sf, "events")
        .select("event_id", "ts")
        .select(
            "event_id",
            amounts.normalize_time(F.date_format(ts, "h"), F.date_format(ts, "mm"), half).alias("from_12h"),
            amounts.normalize_time(F.date_format(ts, "H"), F.date_format(ts, "m"), F.lit("")).alias("from_24h"),
        )
    )


def parse_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Every order total in four notations, and one that is no number."""
    us = F.format_number("o_totalprice", 2)
    plain = F.replace(us, F.lit(","), F.lit(""))
    return (
        render.table(spark, sf, "orders")
        .select("o_orderkey", "o_totalprice")
        .select(
            "o_orderkey",
            amounts.parse_amount(us).alias("us"),
            amounts.parse_amount(F.translate(us, ",.", ".,")).alias("german"),
            amounts.parse_amount(F.replace(plain, F.lit("."), F.lit(","))).alias("comma"),
            amounts.parse_amount(F.replace(us, F.lit(","), F.lit("."))).alias("dots"),
            amounts.parse_amount(F.replace(us, F.lit("."), F.lit(","))).alias("commas_only"),
        )
    )


def currency_codes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    symbol = F.get(F.array(*[F.lit(s) for s in ("$", "€ ", "£", " ¥", "₿", "")]), (key % 6).cast("int"))
    code = F.when(key % 4 == 0, "usd").when(key % 4 == 1, "Lyd").when(key % 4 == 2, "")
    return (
        render.table(spark, sf, "orders")
        .select("o_orderkey")
        .select("o_orderkey", amounts.currency_code(code, symbol).alias("currency"))
    )


# -- extraction --------------------------------------------------------------
def _flat(df: DataFrame, column: str) -> DataFrame:
    return df.select("key", f"{column}.*")


def extract_invoices(spark: SparkSession, sf: str) -> DataFrame:
    texts = render.render_invoices(spark, sf)
    return _flat(texts.select("key", extract_invoice(F.col("text"), OPTIONS).alias("x")), "x")


def extract_tickets(spark: SparkSession, sf: str) -> DataFrame:
    texts = render.render_tickets(spark, sf)
    return _flat(with_ticket(texts, OPTIONS), "flight_ticket")


def _by_kind(kinds: list[Column]) -> Column:
    """One of several ways of writing, chosen by the order's key."""
    key = F.col("o_orderkey")
    return F.coalesce(*[F.when(key % len(kinds) == i, F.concat(*k) if isinstance(k, tuple) else k) for i, k in enumerate(kinds)])


def ticket_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticket fields written in the ways that only the later patterns of each field find."""
    key, day, lit = F.col("o_orderkey"), F.col("day"), F.lit
    ten = F.lpad(key.cast("string"), 10, "0")
    number = (key % 900 + 100).cast("string")
    places = F.array(*[lit(p) for p in ("TIP", "BEN", "TUN", "IST", "CDG")])
    origin, goal = F.get(places, (key % 5).cast("int")), F.get(places, ((key + 1) % 5).cast("int"))
    hour, minute = F.lpad((key % 11 + 1).cast("string"), 2, "0"), F.lpad((key % 60).cast("string"), 2, "0")
    clock = F.concat(hour, lit(":"), minute)
    texts = {
        "ticket_text": _by_kind([
            (lit("ETKT 928 "), ten, lit("/01")), (lit("TKT: 928 "), ten), (lit("no label 928-"), ten), (lit("ticket928"), ten, lit("x")),
            (lit("TICKET 928-"), F.left(ten, lit(8))),
        ]),
        "flight_text": _by_kind([
            (lit("Flight No. : xy "), number), (lit("Flight Date\nLH "), number, lit(" 02JUN")),
            (lit("Flight Date\nXX 456 then uz "), number), (lit("JUN 2025, B737 and TK-"), number), (lit("A3 "), number),
        ]),
        "route_text": _by_kind([
            (lit("("), F.lower(origin), lit(") → ("), goal, lit(")")), (origin, lit(" - "), goal),
            (lit("FROM: "), origin, lit("\nTO: "), goal, lit("\n")),
            (lit("flying from Tunis ("), origin, lit(") 12:00 to Paris "), goal), lit("no route"),
        ]),
        "time_text": _by_kind([
            (lit("Departure "), clock, lit(" PM Arrival 9.40")), (hour, lit("h"), minute, lit(" DEP")),
            (lit("x 01:00\n"), origin, lit(" "), clock, lit(" "), goal, lit(" 21:30\nflight 1:11 2:22")),
            (lit("ARR 23:59\nFlight "), clock, lit(" 08:00")), lit("none"),
        ]),
        "date_text": _by_kind([
            (lit("DEPARTING: x\nDate Mon "), F.date_format(day, "dd MMM yyyy")),
            (lit("Flight Date\nLH 12 "), F.date_format(day, "dd MMM yy")),
            (lit("seat on LH 123 at "), F.date_format(day, "dd/MM/yyyy")),
            (lit("ISSUED 01MAR; "), F.repeat(lit("x"), lit(60)), lit(" go "), F.upper(F.date_format(day, "ddMMM"))),
            (lit("ISSUED "), F.upper(F.date_format(day, "ddMMM"))),
        ]),
        "status_text": _by_kind([lit("x Status HK"), lit("x status HK"), lit("cabin class (ec)"), lit("Class:\n y\nstatus: ok"), lit("classy")]),
    }
    written = _dated_orders(spark, sf).select("o_orderkey", *[t.alias(n) for n, t in texts.items()])
    route, times = ticket.route(F.col("route_text")), ticket.times(F.col("time_text"))
    found = written.select(
        "o_orderkey",
        ticket.ticket_number(F.col("ticket_text")).alias("ticket_number"),
        ticket.flight_number(F.col("flight_text")).alias("flight_number"),
        route.alias("r"),
        times.alias("t"),
        ticket.departure_date(F.col("date_text"), OPTIONS).alias("departure_date"),
        ticket.booking_class(F.col("status_text")).alias("booking_class"),
        ticket.status(F.col("status_text")).alias("status"),
    )
    return found.select(
        "o_orderkey", "ticket_number", "flight_number", F.col("r.origin").alias("origin"), F.col("r.destination").alias("destination"),
        F.col("t.departure_time").alias("departure_time"), F.col("t.arrival_time").alias("arrival_time"), "departure_date", "booking_class", "status",
    )


def invoice_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices in other notations: date in words, total by code or symbol, the customer on a line of its own, or none."""
    key, lit = F.col("o_orderkey"), F.lit
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    us = F.format_number("o_totalprice", 2)
    text_of = _by_kind([
        (lit("Invoice No: INV-"), key, lit("\nBill To:\nACME "), render.letters(key), lit(" GmbH\nInvoice Date: "), F.date_format("day", "d MMMM yyyy"), lit("\nTotal: £ "), us, lit("\n")),
        (lit("Invoice No. B-"), F.lpad(key.cast("string"), 6, "0"), lit("\nDate: "), F.date_format("day", "dd/MM/yyyy"), lit("\nTotal: "), us, lit(" usd\n")),
        (lit("Rechnung\nAmount Due: € "), F.translate(us, ",.", ".,"), lit("\n")),
    ])
    x = extract_invoice(F.col("text"), OPTIONS)
    return orders.select("o_orderkey", text_of.alias("text")).select("o_orderkey", x.alias("x")).select(
        "o_orderkey", "x.invoice_number", "x.customer_name", "x.invoice_date", "x.total_value", "x.currency"
    )


def extract_passports(spark: SparkSession, sf: str) -> DataFrame:
    texts = render.render_passports(spark, sf)
    return _flat(texts.select("key", extract_passport(F.col("text"), OPTIONS).alias("x")), "x")


def invoice_fields_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The invoice extractor on every given text, most of which are no invoices."""
    x = extract_invoice(text.text_or_empty(F.col("text")), OPTIONS)
    return (
        all_texts(spark, sf)
        .select("path", x.alias("x"))
        .select("path", "x.invoice_number", "x.customer_name", "x.invoice_date", "x.total_value", "x.currency")
    )


def _people(spark: SparkSession, sf: str, kinds: int) -> DataFrame:
    """(c_custkey, text): a passenger's name in as many ways of writing it, chosen by the key."""
    key = F.col("c_custkey")
    code = render.letters(key)
    last, first = F.concat(F.lit("QU"), code), F.concat(F.lit("QE"), code)
    kind = key % kinds
    filler = "\nThis line keeps the agent more than forty characters away.\n"
    written = (
        F.when(kind == 0, F.concat(last, F.lit("/"), first, F.lit("MR")))
        .when(kind == 1, F.concat(F.lit("Dear MR "), first, F.lit(" "), last))
        .when(kind == 2, F.concat(F.lit("Passenger Name: "), last, F.lit(", "), first))
        .when(kind == 3, F.concat(F.lit("Passenger\n"), first, F.lit(" "), last, F.lit(" (MR)")))
        .when(kind == 4, F.concat(F.lit("AGENT QX"), code, F.lit("/QY"), code, F.lit(filler), last, F.lit("/"), first))
        .when(kind == 5, F.concat(F.lit("Ref 12: "), last, F.lit(", "), first, F.lit(" MRS")))
        .otherwise(F.concat(F.lit("No 7: "), F.initcap(last), F.lit(" /"), F.initcap(first), F.lit(".")))
    )
    people = balanced(render.table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return people.select("c_custkey", written.alias("text"))


def best_names(spark: SparkSession, sf: str) -> DataFrame:
    """The passenger's name in six ways of writing it."""
    return with_passenger_name(_people(spark, sf, 6), out="name").select("c_custkey", "name")


def name_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Whatever each pass takes for a name, in seven ways of writing it; the last is one that only the relaxed slash pass reads."""
    found = candidate_rows(_people(spark, sf, 7), ("c_custkey",))
    return found.select("c_custkey", "pass", "ord", "name", "start", "priority")


def best_name_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The best of the candidates as a rank over their rows."""
    found = names.best_by_row(candidate_rows(_people(spark, sf, 7), ("c_custkey",)), ("c_custkey",))
    return found.select("c_custkey", "name", "priority", "start")


def pnr_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Booking references without a label of their own: near a word for one, on the next line, a word of the stop list, none."""
    key, lit = F.col("o_orderkey"), F.lit
    code = F.concat(lit("P"), F.lpad(render.letters(key), 5, "Q"))
    written = _by_kind([
        (lit("Your booking: "), code), (lit("my record locator is "), F.lower(code), lit(".")), lit("x pnr ISSUE 12"),
        (lit("the PNR\n\t"), F.left(code, lit(5)), lit(" ok")), (lit("no reference "), code),
    ])
    orders = render.table(spark, sf, "orders").select("o_orderkey")
    return orders.select("o_orderkey", ticket.pnr(written).alias("pnr"))


def carrier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in fixed.KNOWN_AIRLINE_CODES])
    flights = (
        render.table(spark, sf, "orders")
        .select("o_orderkey")
        .withColumn(
            "flight_number",
            F.concat(
                F.get(codes, (F.col("o_orderkey") % len(fixed.KNOWN_AIRLINE_CODES)).cast("int")),
                (F.col("o_orderkey") % 900 + 100).cast("string"),
            ),
        )
    )
    return with_carrier(flights).select("o_orderkey", "flight_number", "carrier")


# -- names and renames -------------------------------------------------------
def invoice_names(spark: SparkSession, sf: str) -> DataFrame:
    x = extract_invoices(spark, sf)
    name = naming.invoice_filename(*[F.col(c) for c in ("invoice_number", "customer_name", "total_value", "invoice_date")])
    return x.select("key", name.alias("name"))


def invoice_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of three decimals and halves of cents as they stand in file names."""
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.select(
        "o_orderkey",
        amounts.fixed_point(F.col("o_totalprice") / 10).alias("tenth"),
        amounts.fixed_point(F.col("o_orderkey") / 8).alias("eighth"),
        amounts.fixed_point((F.col("o_orderkey") * 10 + 5) / 1000).alias("half_cent"),
        amounts.fixed_point(-F.col("o_totalprice") / 1000).alias("negative"),
    )


def ticket_names(spark: SparkSession, sf: str) -> DataFrame:
    x = extract_tickets(spark, sf)
    fields = ("pnr", "passenger_name", "flight_number", "departure_date", "carrier")
    return x.select("key", naming.ticket_filename(*[F.col(c) for c in fields]).alias("name"))


def passport_names(spark: SparkSession, sf: str) -> DataFrame:
    x = extract_passports(spark, sf)
    fields = ("surname", "given_names", "nationality", "date_of_expiry")
    return x.select("key", naming.passport_filename(*[F.col(c) for c in fields]).alias("name"))


def target_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = render.table(spark, sf, "pages").select("page_id", "url")
    path = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(".PDF")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("/"), "page_id", F.lit(".x.pdf")))
        .otherwise(F.concat(F.lit("."), "page_id"))
    )
    name = F.concat(F.lit("N"), naming.extension(path))
    return p.select(
        "page_id",
        naming.target_path(path, name).alias("beside"),
        naming.target_path(path, name, "out/").alias("in_dest"),
    )


def rename_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that fight for a few names, some of which customers' files already have."""
    key = F.col("o_orderkey")
    target = (
        F.when(key % 3 == 0, F.concat(F.lit("out/Inv_"), "o_orderstatus", F.lit(".pdf")))
        .when(key % 3 == 1, F.concat(F.lit("out/Inv_"), (F.col("o_custkey") % 50).cast("string"), F.lit(".pdf")))
        .when(key % 9 == 2, F.concat(F.lit("out/Inv_F-"), (key % 40).cast("string"), F.lit(".pdf")))
    )
    new = (
        render.table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus")
        .select(F.concat(F.lit("in/"), key.cast("string"), F.lit(".pdf")).alias("path_in"), target.alias("target"))
    )
    c = F.col("c_custkey")
    existing = (
        render.table(spark, sf, "customer")
        .select("c_custkey")
        .select(
            F.when(c % 4 == 0, F.concat(F.lit("out/Inv_O-"), c.cast("string"), F.lit(".pdf")))
            .when(c % 4 == 1, F.concat(F.lit("out/Inv_"), (c % 60).cast("string"), F.lit(".pdf")))
            .when(c % 4 == 2, F.concat(F.lit("out/Inv_P-"), F.floor(c / 7).cast("string"), F.lit(".pdf")))
            .otherwise(F.concat(F.lit("out/Inv_F.pdf")))
            .alias("path")
        )
    )
    return plan_renames(new, existing, materialized=True).select("path_in", "path_out")


# -- end to end --------------------------------------------------------------
def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of all rendered documents."""
    out = render.render_invoices(spark, sf)
    return out.unionByName(render.render_tickets(spark, sf)).unionByName(render.render_passports(spark, sf)).select("path", "text")


def analyze_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline with renames over all rendered documents."""
    result = analyze(rendered(spark, sf), rename=True, dest="sorted", options=OPTIONS)
    return result.select("path_in", "path_out", "top_class", "confidence")


def report(spark: SparkSession, sf: str) -> DataFrame:
    return report_rows(analyze(rendered(spark, sf), options=OPTIONS))


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return result_json(analyze(rendered(spark, sf), options=OPTIONS))


def analyze_everything(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered documents and all given texts together, counted per outcome."""
    texts = rendered(spark, sf).unionByName(all_texts(spark, sf))
    result = analyze(texts, options=OPTIONS)
    kind = F.regexp_extract("path_in", "^([a-z]+)/", 1)
    return result.groupBy(kind.alias("kind"), "top_class", "confidence").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "scan_documents": scan_documents,
    "scan_files": scan_files,
    "error_merge": error_merge,
    "rules_table": rules_table,
    "normalize_text": normalize_text,
    "keyword_counts": keyword_counts,
    "regex_counts": regex_counts,
    "fuzzy_boost": fuzzy_boost,
    "name_scalars": name_scalars,
    "plausible_names": plausible_names,
    "sanitize_names": sanitize_names,
    "find_matches": find_all_matches,
    "score_wide": score_wide,
    "score_long": score_long,
    "score_index": score_index,
    "score_many_rules": score_many_rules,
    "softmax_rows": softmax_rows,
    "top_class_rows": top_class_rows,
    "softmax_probs": softmax_probs,
    "top_class": top_class,
    "route_documents": route_documents,
    "parse_dates": parse_dates,
    "day_month_tokens": day_month_tokens,
    "normalize_times": normalize_times,
    "parse_amounts": parse_amounts,
    "currency_codes": currency_codes,
    "extract_invoices": extract_invoices,
    "extract_tickets": extract_tickets,
    "ticket_fallbacks": ticket_fallbacks,
    "invoice_fallbacks": invoice_fallbacks,
    "extract_passports": extract_passports,
    "invoice_fields_of_texts": invoice_fields_of_texts,
    "best_names": best_names,
    "name_candidates": name_candidates,
    "best_name_rows": best_name_rows,
    "pnr_fallbacks": pnr_fallbacks,
    "carrier_lookup": carrier_lookup,
    "invoice_names": invoice_names,
    "invoice_amounts": invoice_amounts,
    "ticket_names": ticket_names,
    "passport_names": passport_names,
    "target_paths": target_paths,
    "rename_plan": rename_plan,
    "analyze_corpus": analyze_corpus,
    "report_rows": report,
    "result_json": json_lines,
    "analyze_everything": analyze_everything,
}
