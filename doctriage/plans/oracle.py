"""The registered queries once more, as plain SQL for another engine.

For rendered documents the SQL reads the columns the texts were made from, so
it shares no pattern with the query it checks.
"""

from __future__ import annotations

from doctriage import fixed
from doctriage.plans import queries as Q
from doctriage.plans.render import CODE_LETTERS, CUSTOMER_LETTERS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL_TEXTS = """
  SELECT 'docs/' || doc_id || '.pdf' AS path, text FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
  UNION ALL SELECT 'turns/' || conv_id || '-' || turn || '.txt', text FROM conversations
"""
NORMALIZED = rf"""
  SELECT path, text, trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')) AS norm
  FROM ({ALL_TEXTS})
"""


def count_of(word: str, column: str = "norm") -> str:
    return f"((length({column}) - length(replace({column}, {lit(word)}, ''))) // {len(word)})"


def matches_of(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, {lit('(?i)' + pattern)}))"


# -- rules -------------------------------------------------------------------
def _rule_terms(rules: dict, near: bool = True) -> list[tuple[str, str, str, str, float]]:
    """(class, kind, pattern, hits expression, weight)"""
    out = []
    for name, config in rules.items():
        for k in config["keywords"]:
            # A keyword is lowered but keeps its accents, so an accented one never matches.
            out.append((name, "keyword", k, count_of(k.lower()), fixed.KEYWORD_WEIGHT))
            if near and len(k) > 5:
                boost = f"CASE WHEN norm <> '' AND NOT contains(norm, {lit(k.lower())}) AND ({_near(k.lower())}) THEN 1 ELSE 0 END"
                out.append((name, "near", k, boost, fixed.FUZZY_BOOST))
        for p in config["phrases"]:
            out.append((name, "phrase", p, count_of(p.lower()), fixed.PHRASE_WEIGHT))
        for r in config["regexes"]:
            out.append((name, "regex", r["pattern"], matches_of(r["pattern"]), r.get("weight", 1.0)))
    return out


def _classes(rules: dict) -> list[str]:
    return [*rules, *[c for c in fixed.BUILTIN_CLASSES if c not in rules]]


def _scores(rules: dict) -> str:
    terms = _rule_terms(rules)
    columns = []
    for c in _classes(rules):
        own = [f"{w} * {hits}" for name, _, _, hits, w in terms if name == c]
        columns.append(f"CAST({' + '.join(own) or '0'} AS DOUBLE) AS \"s_{c}\"")
    return f"SELECT path, {', '.join(columns)} FROM ({NORMALIZED})"


def _probabilities(rules: dict) -> str:
    classes = _classes(rules)
    heat = sum(rules.get(c, {}).get("temperature", 1.0) for c in classes) / len(classes)
    top = "greatest(" + ", ".join(f'"s_{c}"' for c in classes) + ")"
    weights = ", ".join(f"exp((\"s_{c}\" - m) / {heat!r}) AS \"w_{c}\"" for c in classes)
    total = " + ".join(f'"w_{c}"' for c in classes)
    return (
        f"SELECT path, " + ", ".join(f"\"w_{c}\" / ({total}) AS \"p_{c}\"" for c in classes)
        + f" FROM (SELECT path, {weights} FROM (SELECT *, {top} AS m FROM ({_scores(rules)})))"
    )


def _top(rules: dict) -> str:
    classes = _classes(rules)
    whens = " ".join(f"WHEN \"p_{c}\" = conf THEN {lit(c)}" for c in classes)
    best = "greatest(" + ", ".join(f'"p_{c}"' for c in classes) + ")"
    return (
        f"SELECT path, raw_class, CASE WHEN conf < {fixed.DEFAULT_MIN_CONFIDENCE} THEN 'other' ELSE raw_class END AS top_class, "
        f"round_even(conf, 4) AS confidence FROM (SELECT *, CASE {whens} END AS raw_class "
        f"FROM (SELECT *, {best} AS conf FROM ({_probabilities(rules)})))"
    )


def _rule_hits(rules: dict) -> str:
    parts = [
        f"SELECT {lit(c)} AS class, {lit(kind)} AS kind, {lit(p)} AS pattern, {hits} AS hits FROM n"
        for c, kind, p, hits, _ in _rule_terms(rules, near=False)
    ]
    return (
        f"WITH n AS ({NORMALIZED}) SELECT class, kind, pattern, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS documents, "
        f"CAST(sum(hits) AS BIGINT) AS matches FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"
    )


# -- near matches ------------------------------------------------------------
def _near(word: str) -> str:
    """Near matches of a word of 6 to 15 letters by listing what may stand for it.

    Of longer ones, those without a character put in at the ends of a text.
    """
    n = len(word)
    minus1 = sorted({word[:i] + word[i + 1:] for i in range(n)})
    minus2 = sorted({w[:i] + w[i + 1:] for w in minus1 for i in range(n - 1)})
    tests = ["contains(" + lit(word) + ", norm)"]
    ends = list(minus1) + (minus2 if n >= 12 else [])
    tests += [f"(length(norm) >= {n} AND (starts_with(norm, {lit(w)}) OR ends_with(norm, {lit(w)})))" for w in ends]
    if n > 10:
        inside = set(minus1) | {w[:i] + "_" + w[i:] for w in minus1 for i in range(1, n - 1)}
        tests += [f"(length(norm) >= {n} AND norm LIKE {lit('%' + w + '%')})" for w in sorted(inside)]
    return " OR ".join(tests)


def _fuzzy() -> str:
    columns = [
        f"CASE WHEN contains(norm, {lit(w)}) THEN 0.0 WHEN norm <> '' AND ({_near(w)}) THEN 0.5 ELSE 0.0 END::DOUBLE AS \"b_{w.replace(' ', '_')}\""
        for w in Q.FUZZY_WORDS
    ]
    return f"SELECT path, {', '.join(columns)} FROM ({NORMALIZED})"


# -- rendered documents ------------------------------------------------------
def letters(x: str, alphabet: str = CODE_LETTERS) -> str:
    return f"translate(CAST({x} AS VARCHAR), '0123456789', '{alphabet}')"


def titled(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def in_year(day: str) -> str:
    """The day and month in the year of AS_OF, NULL if there is no such day."""
    return f"strftime(try_strptime('{Q.AS_OF.year}-' || strftime({day}, '%m-%d'), '%Y-%m-%d'), '%Y-%m-%d')"


def _list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


CODES = list(fixed.CARRIERS)
INVOICES = f"""
  SELECT o_orderkey AS key, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS invoice_number,
    c_mktsegment || ' ' || {letters('c_custkey', CUSTOMER_LETTERS)} || ' GmbH' AS customer_name,
    strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, round(o_totalprice, 2) AS total_value, 'EUR' AS currency
  FROM orders JOIN customer ON o_custkey = c_custkey
"""
TICKETS = f"""
  SELECT o_orderkey AS key, 'P' || lpad({letters('o_orderkey')}, 5, 'Q') AS pnr,
    '928' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS ticket_number,
    {_list(CODES)}[o_orderkey % 9 + 1] || (100 + o_orderkey % 900) AS flight_number,
    'Qe' || lower({letters('o_custkey')}) || ' Qu' || lower({letters('o_orderkey')}) AS passenger_name,
    {in_year('o_orderdate')} AS departure_date,
    lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS departure_time,
    lpad(CAST((o_orderkey + 3) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((o_orderkey + 7) % 60 AS VARCHAR), 2, '0') AS arrival_time,
    ['TIP', 'BEN', 'TUN', 'IST', 'CDG'][o_orderkey % 5 + 1] AS origin,
    ['TIP', 'BEN', 'TUN', 'IST', 'CDG'][(o_orderkey + 1) % 5 + 1] AS destination,
    'Y' AS booking_class, 'OK' AS status, {_list(fixed.CARRIERS.values())}[o_orderkey % 9 + 1] AS carrier
  FROM orders
"""
PASSPORTS = f"""
  SELECT c_custkey AS key, 'QU' || {letters('c_custkey')} AS surname, 'QE' || {letters('c_custkey')} AS given_names,
    'N' || {letters("lpad(CAST(c_nationkey AS VARCHAR), 2, '0')")} AS nationality,
    strftime(DATE '2026-01-01' + CAST(c_custkey % 3650 AS INTEGER), '%Y-%m-%d') AS date_of_expiry
  FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
PLACES = "['TIP', 'BEN', 'TUN', 'IST', 'CDG']"
CLOCK = "lpad(CAST(o_orderkey % 11 + 1 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')"
TICKET_FALLBACKS = f"""
  SELECT o_orderkey,
    CASE WHEN k < 4 THEN '928' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS ticket_number,
    ['XY', 'LH', 'UZ', 'TK', NULL][k + 1] || (o_orderkey % 900 + 100) AS flight_number,
    CASE WHEN k < 4 THEN {PLACES}[o_orderkey % 5 + 1] END AS origin,
    CASE WHEN k < 4 THEN {PLACES}[(o_orderkey + 1) % 5 + 1] END AS destination,
    CASE WHEN k = 0 THEN (o_orderkey % 11 + 13) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
         WHEN k < 4 THEN {CLOCK} END AS departure_time,
    ['09:40', NULL, '21:30', '23:59', NULL][k + 1] AS arrival_time,
    CASE WHEN k < 3 THEN strftime(day, '%Y-%m-%d') WHEN k = 3 THEN {in_year('day')} END AS departure_date,
    [NULL, NULL, 'EC', 'Y', NULL][k + 1] AS booking_class,
    ['HK', NULL, NULL, 'OK', NULL][k + 1] AS status
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS k FROM orders)
"""
INVOICE_FALLBACKS = f"""
  SELECT o_orderkey,
    CASE k WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN 'B-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END AS invoice_number,
    CASE k WHEN 0 THEN 'ACME ' || {letters('o_orderkey')} || ' GmbH' END AS customer_name,
    CASE WHEN k < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
    round(o_totalprice, 2) AS total_value, ['GBP', 'USD', 'EUR'][k + 1] AS currency
  FROM (SELECT *, o_orderkey % 3 AS k FROM orders)
"""
INVOICE_NAMES = f"""
  SELECT key, 'Inv_' || invoice_number || '_' || customer_name || '_' || printf('%.2f', total_value) || '_' || invoice_date || '.pdf' AS name
  FROM ({INVOICES})
"""
TICKET_NAMES = f"""
  SELECT key, 'Ticket_' || carrier || '_' || pnr || '_' || passenger_name || '_' || flight_number || '_'
    || coalesce(departure_date, 'NA') || '.pdf' AS name FROM ({TICKETS})
"""
PASSPORT_NAMES = f"""
  SELECT key, 'Passport_' || surname || '_' || given_names || '_' || nationality || '_' || date_of_expiry || '.pdf' AS name
  FROM ({PASSPORTS})
"""
# Rule hits of the rendered texts: the label words, the weight-2 invoice and
# the weight-1.5 booking pattern.
INVOICE_SCORES, TICKET_SCORES, PASSPORT_SCORES = (7.0, 0, 0, 0), (0, 7.0, 0, 0), (0, 0, 5.0, 0)


def _confidence(scores: tuple) -> str:
    top = max(scores)
    others = " + ".join(f"exp({s - top}::DOUBLE)" for s in scores)
    return f"round_even(1.0::DOUBLE / ({others}), 4)"


def _rest(scores: tuple) -> str:
    top = max(scores)
    others = " + ".join(f"exp({s - top}::DOUBLE)" for s in scores)
    return f"round_even(exp({-top}::DOUBLE) / ({others}), 4)"


def _end_to_end() -> str:
    parts = []
    for folder, cls, names, scores in (
        ("invoices", "invoice", INVOICE_NAMES, INVOICE_SCORES),
        ("tickets", "flight_ticket", TICKET_NAMES, TICKET_SCORES),
        ("passports", "passport", PASSPORT_NAMES, PASSPORT_SCORES),
    ):
        # Equal names are numbered in the order of the hashed source path.
        parts.append(
            f"SELECT '{folder}/' || key || '.pdf' AS path_in, name, {lit(cls)} AS top_class, "
            f"{_confidence(scores)} AS confidence FROM ({names})"
        )
    return (
        "SELECT path_in, top_class, confidence, 'sorted/' || CASE WHEN k = 0 THEN name "
        "ELSE left(name, length(name) - 4) || '-' || k || '.pdf' END AS path_out FROM ("
        "SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(path_in), path_in) - 1 AS k FROM ("
        + " UNION ALL ".join(parts)
        + "))"
    )


_REPORT_TYPES = {"confidence": "DOUBLE", "total_value": "DOUBLE"}


def _report() -> str:
    parts = []
    for folder, cls, source, scores in (
        ("invoices", "invoice", INVOICES, INVOICE_SCORES),
        ("tickets", "flight_ticket", TICKETS, TICKET_SCORES),
        ("passports", "passport", PASSPORTS, PASSPORT_SCORES),
    ):
        known = {
            "path_in": f"'{folder}/' || key || '.pdf'", "top_class": lit(cls), "confidence": _confidence(scores)
        }
        fields = {
            "invoice": ["invoice_number", "customer_name", "invoice_date", "total_value", "currency"],
            "flight_ticket": ["pnr", "passenger_name", "flight_number", "departure_date", "carrier"],
            "passport": ["surname", "given_names", "nationality", "date_of_expiry"],
        }[cls]
        known.update({f: f for f in fields})
        columns = [f"CAST({known.get(c, 'NULL')} AS {_REPORT_TYPES.get(c, 'VARCHAR')}) AS {c}" for c in fixed.REPORT_COLUMNS]
        parts.append(f"SELECT {', '.join(columns)} FROM ({source})")
    return " UNION ALL ".join(parts)


def _json() -> str:
    def text(x: str) -> str:
        return f"coalesce('\"' || {x} || '\"', 'null')"

    parts = []
    for folder, cls, source, scores, fields in (
        ("invoices", "invoice", INVOICES, INVOICE_SCORES, ["invoice_number", "customer_name", "invoice_date", "total_value", "currency"]),
        (
            "tickets", "flight_ticket", TICKETS, TICKET_SCORES,
            ["pnr", "ticket_number", "flight_number", "passenger_name", "departure_date", "departure_time", "arrival_time",
             "origin", "destination", "booking_class", "status", "carrier"],
        ),
        ("passports", "passport", PASSPORTS, PASSPORT_SCORES, ["surname", "given_names", "nationality", "date_of_expiry"]),
    ):
        small = f"CASE WHEN {_rest(scores)} < 0.001 THEN '9.0E-4' ELSE CAST({_rest(scores)} AS VARCHAR) END"
        probs = " || ',' || ".join(
            f"'\"{c}\":' || " + (f"CAST({_confidence(scores)} AS VARCHAR)" if c == cls else small)
            for c in fixed.BUILTIN_CLASSES
        )
        values = " || ',' || ".join(
            f"'\"{f}\":' || " + ("CAST(total_value AS VARCHAR)" if f == "total_value" else text(f)) for f in fields
        )
        parts.append(
            f"SELECT '{{\"path_in\":\"{folder}/' || key || '.pdf\",\"path_out\":null,\"top_class\":\"{cls}\",\"confidence\":' || "
            f"CAST({_confidence(scores)} AS VARCHAR) || ',\"probabilities\":{{' || {probs} || '}},\"extracted\":{{' || {values} "
            f"|| '}},\"errors\":null}}' AS json FROM ({source})"
        )
    return " UNION ALL ".join(parts)


# -- renames -----------------------------------------------------------------
RENAMES = r"""
WITH new AS (
  SELECT 'in/' || o_orderkey || '.pdf' AS path_in,
    CASE WHEN o_orderkey % 3 = 0 THEN 'out/Inv_' || o_orderstatus || '.pdf'
         WHEN o_orderkey % 3 = 1 THEN 'out/Inv_' || (o_custkey % 50) || '.pdf'
         WHEN o_orderkey % 9 = 2 THEN 'out/Inv_F-' || (o_orderkey % 40) || '.pdf' END AS target
  FROM orders
), existing AS (
  SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'out/Inv_O-' || c_custkey || '.pdf'
    WHEN 1 THEN 'out/Inv_' || (c_custkey % 60) || '.pdf'
    WHEN 2 THEN 'out/Inv_P-' || (c_custkey // 7) || '.pdf' ELSE 'out/Inv_F.pdf' END AS path
  FROM customer
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(path_in), path_in) AS k FROM new WHERE target IS NOT NULL
), asked AS (SELECT target, count(*) AS n FROM ranked GROUP BY target),
offered AS (
  SELECT target, i, CASE WHEN i = 0 THEN target ELSE left(target, length(target) - 4) || '-' || i || '.pdf' END AS path
  FROM (SELECT target, unnest(range(n + (SELECT count(*) FROM existing) + (SELECT count(*) FROM asked))) AS i FROM asked)
), free AS (
  SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY i) AS k FROM offered o
  WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.path = o.path)
    AND (i = 0 OR NOT EXISTS (SELECT 1 FROM asked a WHERE a.target = o.path))
)
SELECT path_in, path AS path_out FROM ranked JOIN free USING (target, k)
UNION ALL SELECT path_in, NULL FROM new WHERE target IS NULL
"""


def _targets() -> str:
    path = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.PDF' WHEN 2 THEN '/' || page_id || '.x.pdf'
      ELSE '.' || page_id END"""
    return rf"""
    SELECT page_id, CASE WHEN dir = '' THEN '' WHEN dir = '/' THEN '/' ELSE dir || '/' END || 'N' || ext AS beside, 'out/N' || ext AS in_dest
    FROM (SELECT page_id, CASE WHEN contains(p, '/') THEN CASE WHEN slash = 1 THEN '/' ELSE left(p, slash - 1) END ELSE '' END AS dir,
      CASE WHEN contains(ltrim(base, '.'), '.') THEN '.' || list_last(string_split(base, '.')) ELSE '.pdf' END AS ext
      FROM (SELECT page_id, p, length(p) - length(list_last(string_split(p, '/'))) AS slash, list_last(string_split(p, '/')) AS base
        FROM (SELECT page_id, {path} AS p FROM pages)))
    """


# -- names -------------------------------------------------------------------
def _name_scalars() -> str:
    c = letters("c_custkey")
    t = titled(c)
    title = f"""CASE c_custkey % 5 WHEN 0 THEN 'Mc' || {t} WHEN 1 THEN 'O''' || {t}
      WHEN 2 THEN 'D''' || {t} || ' X' || lower({c})
      WHEN 3 THEN 'Q' || lower({c}) || ' Mc''' || {t} ELSE 'Q' || lower({c}) || '''Z' || lower({c}) END"""
    return f"""
    SELECT c_custkey, {title} AS titled, {t} || ' ' || {title} AS full_name,
      'Q' || {c} || CASE WHEN c_custkey % 5 < 4 THEN '' ELSE 'X' END AS unglued,
      'Q' || {c} || CASE WHEN c_custkey % 5 < 3 THEN '' ELSE ' (Du)' END AS unmarked
    FROM customer"""


def _plausible() -> str:
    barred = _list([*fixed.NAME_STOPWORDS, *fixed.MONTHS])
    return rf"""
    SELECT path, CAST(len(list_filter(list_transform(string_split_regex(text, '[.,;:\n]'), lambda f: trim(f, ' ,')), lambda f:
      regexp_full_match(f, '[A-Za-z ''\-]{{4,80}}')
      AND len(list_filter(string_split(f, ' '), lambda w: w <> '')) BETWEEN 2 AND 4
      AND len(list_filter(string_split(f, ' '), lambda w: w <> '' AND length(regexp_replace(w, '[^A-Za-z]', '', 'g')) < 2)) = 0
      AND NOT list_has_any(list_transform(string_split(upper(f), ' '), lambda w: regexp_replace(w, '[^A-Z]', '', 'g')), {barred})
    )) AS BIGINT) AS n_plausible FROM ({ALL_TEXTS})"""


def _dates() -> str:
    day = "CAST(o_orderdate AS DATE)"
    n = len(Q.DATE_FORMATS)
    return f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % {n} = {n - 1} THEN NULL ELSE strftime({day}, '%Y-%m-%d') END AS iso,
      CASE WHEN day({day}) <= 12 THEN strftime(make_date(year({day}), day({day}), month({day})), '%Y-%m-%d')
           ELSE strftime({day}, '%Y-%m-%d') END AS iso_us,
      strftime({day}, '%Y-%m-%d') AS iso_opt_in, CAST(NULL AS VARCHAR) AS impossible
    FROM orders"""


def _currency() -> str:
    return """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'USD' WHEN o_orderkey % 4 = 1 THEN 'LYD'
      ELSE CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' END END AS currency
    FROM orders"""


def _invoice_fields() -> str:
    number = lit(fixed.INVOICE_NUMBER)
    customer = lit(fixed.CUSTOMER)
    amount = lit(fixed.AMOUNT.replace("{number}", fixed.GROUPED_NUMBER))
    date = lit(fixed.INVOICE_DATE.replace("{forms}", fixed.DATE_FORMS))
    return rf"""
    SELECT path, nullif(regexp_extract(text, {number}, 3), '') AS invoice_number,
      nullif(trim(regexp_replace(regexp_extract(text, {customer}, 2), '\s+', ' ', 'g')), '') AS customer_name,
      CASE WHEN regexp_extract(text, {date}, 2) <> '' THEN 'unexpected' END AS invoice_date,
      CASE WHEN regexp_extract(text, {amount}, 3) <> '' THEN -1.0 END::DOUBLE AS total_value,
      nullif(upper(regexp_extract(text, {amount}, 4)), '') AS currency
    FROM ({ALL_TEXTS})"""


def _find_matches() -> str:
    p = lit(Q.MATCH_PATTERN)
    return f"""
    SELECT path, CAST(start AS BIGINT) AS start, match, substr(text, greatest(start - 12, 0) + 1, least(start, 12)) AS before,
      substr(text, start + length(match) + 1, 12) AS after
    FROM (SELECT path, text, hits[i] AS match,
        CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) AS BIGINT)
          + coalesce(CAST(list_sum(list_transform(hits[:i - 1], lambda h: length(h))) AS BIGINT), 0) AS start
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT path, text, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM ({ALL_TEXTS}))))"""


def _best_names() -> str:
    c = f"lower({letters('c_custkey')})"
    return f"""
    SELECT c_custkey, 'Qe' || {c} || CASE WHEN c_custkey % 6 = 5 THEN ' Mrs' ELSE '' END || ' Qu' || {c} AS name FROM customer"""


_NAME_ROWS = [
    # (way of writing, pass, place in the list, name, where it starts, priority)
    (0, 0, 0, "'Qe' || c || ' Qu' || c", "0", 5), (0, 4, 1, "'Qe' || c || ' Qu' || c", "0", 2),
    (1, 1, 0, "'Qe' || c || ' Qu' || c", "5", 4),
    (2, 2, 0, "'Qe' || c || ' Qu' || c", "16", 4), (2, 5, 1, "'Qe' || c || ' Qu' || c", "16", 2),
    (3, 2, 0, "'Qe' || c || ' Qu' || c", "10", 3), (3, 3, 1, "'Qe' || c || ' Qu' || c", "10", 3),
    (4, 4, 0, "'Qy' || c || ' Agent Qx' || c", "0", 2), (4, 4, 1, "'Qe' || c || ' Qu' || c", "8 + length(c) + 3 + length(c) + 60", 2),
    (5, 5, 0, "'Qe' || c || ' Mrs Qu' || c", "8", 2),
    (6, 4, 0, "'Qe' || c || ' Qu' || c", "6", 2),
]


def _name_rows(best: bool) -> str:
    """Candidates of each way of writing; the best is the first but where the agent comes before."""
    rows = [r for r in _NAME_ROWS if not best or r[2] == (r[0] == 4)]
    columns = "" if best else "CAST({1} AS INTEGER) AS pass, CAST({2} AS INTEGER) AS ord, "
    parts = [
        f"SELECT c_custkey, {columns.format(*r)}{r[3]} AS name, CAST({r[4]} AS INTEGER) AS start, CAST({r[5]} AS INTEGER) AS priority FROM p WHERE c_custkey % 7 = {r[0]}"
        for r in rows
    ]
    return f"WITH p AS (SELECT c_custkey, lower({letters('c_custkey')}) AS c FROM customer) " + " UNION ALL ".join(parts)


_BUILTIN_LIST = _list(fixed.BUILTIN_CLASSES)
MANY_RULES = rf"""
  WITH n AS ({NORMALIZED}), rules AS (
    SELECT DISTINCT 'c' || item_id % 5 AS class, unnest(string_split(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), ' ')) AS word FROM benchmark
  ), hits AS (
    SELECT path, class, CAST(sum((length(norm) - length(replace(norm, word, ''))) // length(word)) AS DOUBLE) AS score
    FROM n JOIN rules ON contains(norm, word) WHERE length(word) >= 4 GROUP BY ALL
  ), classes AS (SELECT DISTINCT class FROM rules WHERE length(word) >= 4 UNION SELECT unnest({_BUILTIN_LIST}))
  SELECT path, class, coalesce(score, 0) AS score FROM n CROSS JOIN classes LEFT JOIN hits USING (path, class)
"""
PNR_FALLBACKS = f"""
  SELECT o_orderkey, CASE WHEN k < 2 THEN code WHEN k = 3 THEN left(code, 5) END AS pnr
  FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 'P' || lpad({letters('o_orderkey')}, 5, 'Q') AS code FROM orders)
"""


def _everything() -> str:
    rows = [
        f"SELECT '{k}' AS kind, '{c}' AS top_class, {_confidence(s)} AS confidence, count(*) AS documents FROM ({src}) GROUP BY ALL"
        for k, c, s, src in (
            ("invoices", "invoice", INVOICE_SCORES, INVOICES),
            ("tickets", "flight_ticket", TICKET_SCORES, TICKETS),
            ("passports", "passport", PASSPORT_SCORES, PASSPORTS),
        )
    ]
    rows.append(
        "SELECT regexp_extract(path, '^([a-z]+)/', 1) AS kind, top_class, confidence, count(*) AS documents "
        f"FROM ({_top(fixed.DEFAULT_RULES)}) GROUP BY ALL"
    )
    return " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    counts = ", ".join(f"CAST({count_of(w)} AS BIGINT) AS \"n_{w}\"" for w in Q.COUNTED_WORDS)
    patterns = ", ".join(f"CAST({matches_of(p)} AS BIGINT) AS n_{i}" for i, p in enumerate(Q.COUNTED_PATTERNS))
    long_scores = " UNION ALL ".join(
        f"SELECT path, {lit(c)} AS class, \"s_{c}\" AS score FROM s" for c in _classes(Q.WORD_RULES)
    )
    long_probs = " UNION ALL ".join(f"SELECT path, {lit(c)} AS class, round_even(\"p_{c}\", 4) AS probability FROM s" for c in _classes(Q.WORD_RULES))
    probs = ", ".join(f"round_even(\"p_{c}\", 4) AS \"p_{c}\"" for c in _classes(Q.WORD_RULES))
    codes = _list(fixed.KNOWN_AIRLINE_CODES)
    carriers = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in fixed.CARRIERS.items())
    illegal = fixed.ILLEGAL_NAME_CHARS
    return {
        "scan_documents": """SELECT 'docs/' || doc_id || '.pdf' AS path, CAST(length(text) AS INTEGER) AS chars,
            CAST(strlen(text) AS INTEGER) AS bytes, CAST(NULL AS VARCHAR) AS errors FROM documents""",
        "scan_files": f"SELECT unnest({_list(TABLES)}) AS \"table\", CAST(0 AS BIGINT) AS differing",
        "error_merge": """SELECT doc_id, nullif(concat_ws(' | ', CASE WHEN lang = 'de' THEN 'load_error: ' || source END,
            CASE WHEN lang <> 'fr' AND doc_id % 3 = 0 THEN 'ocr_error: blank' END,
            CASE WHEN doc_id % 5 = 0 THEN 'rename_error: denied' END), '') AS errors FROM documents""",
        "rules_table": _rule_hits(Q.WORD_RULES),
        "normalize_text": f"SELECT path, norm FROM ({NORMALIZED})",
        "keyword_counts": f"SELECT path, {counts} FROM ({NORMALIZED})",
        "regex_counts": f"SELECT path, {patterns} FROM ({ALL_TEXTS})",
        "fuzzy_boost": _fuzzy(),
        "name_scalars": _name_scalars(),
        "plausible_names": _plausible(),
        "sanitize_names": rf"""SELECT left(trim(trim(regexp_replace(regexp_replace(name, {lit(illegal)}, '_', 'g'), '\s+', ' ', 'g')), '. '), 180) AS clean
            FROM (SELECT text AS name FROM ({ALL_TEXTS}) UNION ALL SELECT url FROM pages)""",
        "find_matches": _find_matches(),
        "score_wide": _scores(Q.WORD_RULES),
        "score_long": f"WITH s AS ({_scores(Q.WORD_RULES)}) {long_scores}",
        "score_index": f"WITH s AS ({_scores(Q.WORD_RULES)}) {long_scores}",
        "score_many_rules": MANY_RULES,
        "softmax_rows": f"WITH s AS ({_probabilities(Q.WORD_RULES)}) {long_probs}",
        "top_class_rows": _top(Q.WORD_RULES),
        "softmax_probs": f"SELECT path, {probs} FROM ({_probabilities(Q.WORD_RULES)})",
        "top_class": _top(Q.WORD_RULES),
        "route_documents": f"""SELECT *, raw_class = 'invoice' AS has_invoice, raw_class = 'flight_ticket' AS has_flight_ticket,
            raw_class = 'passport' AS has_passport FROM ({_top(fixed.DEFAULT_RULES)})""",
        "parse_dates": _dates(),
        "day_month_tokens": f"""SELECT o_orderkey, {in_year('o_orderdate')} AS glued, {in_year('o_orderdate')} AS spaced FROM orders""",
        "normalize_times": "SELECT event_id, strftime(ts, '%H:%M') AS from_12h, strftime(ts, '%H:%M') AS from_24h FROM events",
        "parse_amounts": """SELECT o_orderkey, round(o_totalprice, 2) AS us, round(o_totalprice, 2) AS german, round(o_totalprice, 2) AS comma,
            round(o_totalprice, 2) AS dots,
            CASE WHEN o_totalprice < 999.995 THEN round(o_totalprice, 2) END AS commas_only FROM orders""",
        "currency_codes": _currency(),
        "extract_invoices": INVOICES,
        "extract_tickets": TICKETS,
        "extract_passports": PASSPORTS,
        "invoice_fields_of_texts": _invoice_fields(),
        "best_names": _best_names(),
        "name_candidates": _name_rows(best=False),
        "best_name_rows": _name_rows(best=True),
        "pnr_fallbacks": PNR_FALLBACKS,
        "carrier_lookup": f"""SELECT o_orderkey, flight_number, carrier FROM (SELECT o_orderkey,
            {codes}[o_orderkey % {len(fixed.KNOWN_AIRLINE_CODES)} + 1] || (o_orderkey % 900 + 100) AS flight_number FROM orders)
            LEFT JOIN (VALUES {carriers}) AS c(code, carrier) ON left(flight_number, 2) = code""",
        "ticket_fallbacks": TICKET_FALLBACKS,
        "invoice_fallbacks": INVOICE_FALLBACKS,
        "invoice_names": INVOICE_NAMES,
        "invoice_amounts": """SELECT o_orderkey, printf('%.2f', o_totalprice / 10) AS tenth, printf('%.2f', o_orderkey / 8) AS eighth,
            printf('%.2f', (o_orderkey * 10 + 5) / 1000) AS half_cent, printf('%.2f', -o_totalprice / 1000) AS negative FROM orders""",
        "ticket_names": TICKET_NAMES,
        "passport_names": PASSPORT_NAMES,
        "target_paths": _targets(),
        "rename_plan": RENAMES,
        "analyze_corpus": _end_to_end(),
        "report_rows": _report(),
        "result_json": _json(),
        "analyze_everything": _everything(),
    }
