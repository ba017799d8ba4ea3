"""Document texts rendered from business tables.

Extraction can be checked against the very columns a text was made from.  The
texts are derived by Spark from whole tables, one document per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.sources.corpus import balanced

# Letters for the digits 0-9 that spell neither a title nor a stopword.
CODE_LETTERS = "BCEGHKLNPT"
CUSTOMER_LETTERS = "ABCDEFGHIJ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(number: Column, alphabet: str = CODE_LETTERS) -> Column:
    return F.translate(number.cast("string"), "0123456789", alphabet)


def _text(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def render_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, key): an invoice per order, billed to its customer."""
    orders = balanced(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    sold = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return sold.select(
        F.concat(F.lit("invoices/"), F.col("o_orderkey"), F.lit(".pdf")).alias("path"),
        _text(
            _line("Invoice No: INV-", F.lpad(F.col("o_orderkey").cast("string"), 6, "0")),
            F.concat(
                F.lit("Bill To: "), "c_mktsegment", F.lit(" "), letters(F.col("c_custkey"), CUSTOMER_LETTERS), F.lit(" GmbH")
            ),
            _line("Invoice Date: ", F.date_format("o_orderdate", "dd.MM.yyyy")),
            _line("Amount Due: € ", amount),
        ).alias("text"),
        F.col("o_orderkey").alias("key"),
    )


def render_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, key): a flight ticket per order."""
    orders = balanced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    codes = F.array(*[F.lit(c) for c in fixed.CARRIERS])
    places = F.array(*[F.lit(c) for c in ("TIP", "BEN", "TUN", "IST", "CDG")])
    clock = F.concat_ws(
        ":", *[F.lpad(x.cast("string"), 2, "0") for x in (key % 24, key % 60)]
    )
    later = F.concat_ws(
        ":", *[F.lpad(x.cast("string"), 2, "0") for x in ((key + 3) % 24, (key + 7) % 60)]
    )
    return orders.select(
        F.concat(F.lit("tickets/"), key, F.lit(".pdf")).alias("path"),
        _text(
            _line("ELECTRONIC TICKET 928-", F.lpad(key.cast("string"), 10, "0")),
            _line("PNR: P", F.lpad(letters(key), 5, "Q")),
            F.concat(
                F.lit("Flight Number: "), F.get(codes, (key % 9).cast("int")), (100 + key % 900).cast("string")
            ),
            F.concat(F.lit("Passenger: QU"), letters(key), F.lit("/QE"), letters(customer), F.lit("MR")),
            F.lit("Class: Y"),
            F.lit("Status: OK"),
            F.concat(
                F.lit("("), F.get(places, (key % 5).cast("int")), F.lit(") - ("),
                F.get(places, ((key + 1) % 5).cast("int")), F.lit(")"),
            ),
            _line("Departure ", clock),
            _line("Arrival ", later),
            _line("Travel ", F.upper(F.date_format("o_orderdate", "ddMMM"))),
        ).alias("text"),
        key.alias("key"),
    )


def render_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, key): a passport per customer."""
    customers = balanced(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    people = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    expiry = F.date_add(F.lit("2026-01-01").cast("date"), (key % 3650).cast("int"))
    return people.select(
        F.concat(F.lit("passports/"), key, F.lit(".pdf")).alias("path"),
        _text(
            F.lit("PASSPORT"),
            _line("Nationality: N", letters(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))),
            _line("Given Names: QE", letters(key)),
            _line("Surname: QU", letters(key)),
            _line("Date of Expiry: ", F.date_format(expiry, "dd.MM.yyyy")),
        ).alias("text"),
        key.alias("key"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, key) of the documents table."""
    docs = balanced(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".pdf")).alias("path"), "text", F.col("doc_id").alias("key"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, key) of the web pages, as raw HTML."""
    web = balanced(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return web.select(
        F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("text"), F.col("page_id").alias("key")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the conversation turns."""
    talk = balanced(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return talk.select(F.concat(F.lit("turns/"), "conv_id", F.lit("-"), "turn", F.lit(".txt")).alias("path"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of all rendered documents and all documents given as text."""
    parts = [
        render_invoices(spark, sf_dir),
        render_tickets(spark, sf_dir),
        render_passports(spark, sf_dir),
        documents(spark, sf_dir),
        pages(spark, sf_dir),
        turns(spark, sf_dir),
    ]
    out = parts[0].select("path", "text")
    for p in parts[1:]:
        out = out.unionByName(p.select("path", "text"))
    return out
