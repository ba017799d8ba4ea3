"""Fixed values.

Everything in this module is data that has to be exactly this for results to
be right: word lists, lookup tables, weights, patterns and formats.  It is kept
together and in plain text so that it can be reviewed at a glance; no logic
lives here.
"""

# --------------------------------------------------------------------------
# Classification
# --------------------------------------------------------------------------
INVOICE, FLIGHT_TICKET, PASSPORT, OTHER = "invoice", "flight_ticket", "passport", "other"
BUILTIN_CLASSES = (INVOICE, FLIGHT_TICKET, PASSPORT, OTHER)

KEYWORD_WEIGHT = 1.0
PHRASE_WEIGHT = 1.5
DEFAULT_REGEX_WEIGHT = 1.0
FUZZY_BOOST = 0.5
DEFAULT_TEMPERATURE = 1.0
MIN_TEMPERATURE = 1e-6
DEFAULT_MIN_CONFIDENCE = 0.6

DEFAULT_RULES = {
    "invoice": {
        "temperature": 1.0,
        "keywords": [
            "invoice", "invoice no", "invoice number", "amount due", "vat", "bill to",
            "subtotal", "po #", "purchase order",
        ],
        "phrases": ["payment terms", "due date", "tax"],
        "regexes": [
            {"pattern": r"(?i)invoice\s*(no\.|no|number)\s*[:#]?\s*[A-Z0-9-]{3,}", "weight": 2.0},
        ],
    },
    "flight_ticket": {
        "temperature": 1.0,
        "keywords": [
            "e-ticket", "pnr", "flight", "boarding", "gate", "departure", "arrival", "carrier",
            "itinerary", "seat",
        ],
        "phrases": ["electronic ticket", "booking reference"],
        "regexes": [
            {"pattern": r"(?i)PNR\s*[:#]?\s*[A-Z0-9]{5,7}", "weight": 1.5},
        ],
    },
    "passport": {
        "temperature": 1.0,
        "keywords": [
            "passport", "nationality", "given names", "date of expiry", "place of birth",
            "surname", "issuing authority", "date of issue", "mrz",
        ],
        "phrases": ["machine readable zone"],
        "regexes": [
            {"pattern": r"[P<][A-Z]{3}[A-Z<]{1,39}<<[A-Z<]{1,39}[0-9<]{9}[A-Z0-9<]{1,}", "weight": 3.0},
        ],
    },
    "other": {"temperature": 1.0, "keywords": [], "phrases": [], "regexes": []},
}

# --------------------------------------------------------------------------
# Word lists and lookup tables
# --------------------------------------------------------------------------
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "SEPT": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}
FULL_MONTHS = {
    "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "JUNE": 6, "JULY": 7,
    "AUGUST": 8, "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12,
}

TITLES = [
    "MR", "MRS", "MS", "MISS", "MSTR", "DR", "PROF", "REV", "JR", "SR", "II", "III", "IV",
    "MME", "MLLE", "SIR", "LADY", "INF", "CHD",
]

NAME_STOPWORDS = [
    "AIR", "AIRWAYS", "AIRLINE", "AERO", "BURAQ", "BERNIQ", "MEDSKY", "LIBYAN", "WINGS", "CARRIER",
    "BOARDING", "GATE", "ARRIVAL", "DEPARTURE", "DEPARTING", "ARRIVING", "FLIGHT", "ORIGIN",
    "DESTINATION", "AIRPORT", "TERMINAL", "VARS", "PERSON", "KG", "CO2", "EMISSIONS", "CHECKMYTRIP", "APP",
    "ELECTRONIC", "TICKET", "RECEIPT", "REFERENCE", "RECORD", "LOCATOR", "CONTACT", "NAME", "PASSENGER",
    "AGENT", "VIEWER", "AGENCY", "CONSULTANT", "ISSUED", "BY", "CHANGE", "REISSUE", "REVALIDATION", "VALID",
    "NONREF", "NONEND", "END", "RULE", "RULES", "FARE", "CLASS", "CABIN", "BAGGAGE", "ALLOWANCE", "TAX",
    "TAXES", "TOTAL", "PENALTY", "CANCEL", "CANCELLATION", "REFUND", "DATE", "ISSUE", "NUMBERS", "NUMBER",
    "NBR", "NBR.",
]
NAME_VETO_WORDS = ["AGENT", "CONTACT", "VIEWER"]

# Flight codes are letters only in the patterns, so codes with a digit can
# never be met; they are listed because they belong to the allow-list.
KNOWN_AIRLINE_CODES = [
    "NB", "BM", "UZ", "YL", "KM", "AF", "TK", "BJ", "TU", "KL", "AZ", "LH", "BA", "EK", "QR", "MS",
    "PC", "A3", "W6", "FR", "U2", "VY", "TP", "IB", "SN", "OS", "LX", "LO",
]
CARRIERS = {
    "NB": "Berniq Airways", "BM": "MedSky Airways", "UZ": "Buraq Air", "YL": "Libyan Wings",
    "AF": "Air France", "TK": "Turkish Airlines", "BJ": "Nouvelair", "TU": "Tunisair",
    "KM": "KM Malta Airlines",
}

CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}

PNR_STOPLIST = ["ISSUE", "DATE", "TUN", "CDG", "IST", "EDI"]
DEPARTURE_LABELS = ["DEPARTURE", "DEP", "STD", "ETD"]
ARRIVAL_LABELS = ["ARRIVAL", "ARR", "STA", "ETA"]
TIME_LINE_WORDS = ["DEPART", "ARRIV", "FLIGHT", "ROUTE", "TUN", "BEN", "CDG", "IST", "TIP", "EDI"]
ISSUE_WORDS = ["ISSUE", "ISSUED", "ISSUANCE", "EMISSION", "ÉMISSION", "EMISIÓN", "EMISSAO"]

# Name ranking: points by number of words, by priority of the pass, and the
# penalties per character of the name and per character of its offset.
NAME_POINTS_TWO_WORDS, NAME_POINTS_THREE_WORDS, NAME_POINTS_OTHER = 2.2, 1.7, 1.0
NAME_POINTS_PRIORITY, NAME_PENALTY_LENGTH, NAME_PENALTY_OFFSET = 0.8, 0.01, 0.000001

# --------------------------------------------------------------------------
# Patterns (functions.regex adds the flags; {forms}, {titles}, ... are filled in)
# --------------------------------------------------------------------------
DATE_FORMS = (
    r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
    r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}"
    r"|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}"
)
ISO_DATE_FORM = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

# invoices
INVOICE_NUMBER = r"(?i)(invoice\s*(no\.|no|number)?\s*[:#]?\s*)([A-Z0-9-]{3,})"
CUSTOMER = r"(?is)(bill to|billed to|customer)\s*[:\n\r]+\s*([\p{L} \-\.,&]{2,80})"
INVOICE_DATE = r"(?i)(invoice date|date of issue|issue date|date)\s*[:#-]?\s*({forms})"
AMOUNT = (
    r"(?is)(total amount|amount due|grand total|total)\s*[:#-]?\s*([\p{Sc}$€£¥]?\s*)?"
    r"({number})\s*(LYD|USD|EUR|GBP|SAR|AED)?"
)
GROUPED_NUMBER = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{2})?"
UNGROUPED_NUMBER = r"[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{2})?(?![0-9])|[0-9]+(?:[.,][0-9]{2})?"
CUSTOMER_FALLBACK = r"(?i)\b(Passenger Name|Name)\b\s*[:#]?\s*([A-Z][A-Za-z '\-]{3,80})"

# tickets
PNR_LABELLED = (
    r"(?im)^\s*(?:Booking\s+Ref(?:erence|rence)|Record\s+Locator|PNR|Reservation\s+Code|Booking\s+Code)"
    r"\s*(?:\(\s*PNR\s*\))?\s*[:#]?\s*(?:\r?\n)?\s*([A-Z][A-Z0-9]{4,6})\b"
)
PNR_NEARBY = r"(?is)\b(booking|locator|référence|record\s+locator|pnr)\b.{0,80}?([A-Z][A-Z0-9]{4,6})\b"
TICKET_SEPARATOR = r"(?:-|[ \t\u00A0\u2007\u202F])?"
TICKET_LABELLED = (
    r"(?i)\b(?:ETKT|E-?TKT|ELECTRONIC\s+TICKET|TICKET(?:\s*(?:NO|NBR|NUMBER))?|TKT)\b"
    r"\D{0,20}(\d{3})" + TICKET_SEPARATOR + r"(\d{10})(?:\s*/\s*\d{1,2})?"
)
TICKET_ANYWHERE = r"\b(\d{3})" + TICKET_SEPARATOR + r"(\d{10})(?:\s*/\s*\d{1,2})?\b"
TICKET_NEARBY = r"(?i)(?:ETKT|E-?TKT|TICKET|ELECTRONIC)\D{0,20}(\d{13})"

NAME_STRICT_SLASH = r"(?<![A-Z])([A-Z][A-Z'\-]{1,39})/([A-Z][A-Z'\-]{1,39})(?![A-Z])"
NAME_TITLE_FIRST = (
    r"(?i)\b(MR|MRS|MS|MISS|MSTR|DR|PROF)\.?\s+([A-Z][A-Z'\-]{2,40})(?:\s+([A-Z][A-Z'\-]{2,40}))\b"
)
NAME_LABEL_SAME_LINE = (
    r"(?i)\b(Passenger(?:\s*Name)?|PAX(?:\s*Name)?|Name\s+of\s+Passenger)\b\s*[:#]?\s*([A-Z ,'\-()]{4,120})"
)
NAME_LABEL_NEXT_LINE = (
    r"(?is)\b(Passenger(?:\s*Name)?|PAX(?:\s*Name)?|Name\s+of\s+Passenger)\b\s*[:#]?\s*\r?\n\s*"
    r"([A-Z ,'\-()]{4,120})"
)
NAME_LABEL_COMMA = r"^\s*([A-Z'\- ]{2,40}),\s*([A-Z'\- ]{2,40})(?:\s+(?:{titles})\.?)?$"
NAME_RELAXED_SLASH = r"(?i)\b([A-Z][A-Z'\- ]{1,40})/([A-Z][A-Z'\- ]{1,40})\b"
NAME_COMMA = r"(?i)\b([A-Z][A-Z'\- ]{2,40}),\s*([A-Z][A-Z'\- ]{2,40})(?:\s+(?:{titles})\.?)?\b"

FLIGHT_LABELLED = r"(?i)\bFlight[-\s]*(?:Number|No\.?|N°)\b[^A-Za-z0-9]{0,10}([A-Z]{2,3}\s*\d{2,4})"
FLIGHT_TABLE = r"(?is)\bFlight\s+Date\b.*?\b([A-Z]{2,3})\s*(\d{2,4})\b"
FLIGHT_KNOWN_CODE = r"(?i)\b({codes})\s*[- ]?\s*(\d{2,4})\b"

ROUTE_PARENTHESISED = r"(?is)\(([A-Z]{3})\)\s*[-–—/>\u2192]\s*\(([A-Z]{3})\)"
ROUTE_BARE = r"(?is)\b([A-Z]{3})\b\s*[-–—/>\u2192]\s*\b([A-Z]{3})\b"
ROUTE_FROM_TO = r"(?is)\bfrom\b.*?\(?\b([A-Z]{3})\b\)?[^A-Za-z]{0,60}\bto\b.*?\(?\b([A-Z]{3})\b\)?"

TIME_OF_DAY = r"([01]?\d|2\d)(?::|\.|[hH])?([0-5]\d)\s*(?:([AaPp][Mm]))?"
TIME_AFTER_LABEL = r"(?im)\b{label}\b[^0-9A-Za-z]{0,12}" + TIME_OF_DAY
TIME_BEFORE_LABEL = r"(?im)" + TIME_OF_DAY + r"[^0-9A-Za-z]{0,12}\b{label}\b"

CLASS_LINE = r"(?im)^\s*CLASS\s*:\s*(?:\r?\n)?\s*([A-Z]{1,2})\b"
CLASS_ANYWHERE = r"(?i)\bCLASS\b[^A-Za-z0-9]{0,5}([A-Z]{1,2})\b"
STATUS_LINE = r"(?im)^\s*STATUS\s*:\s*(?:\r?\n)?\s*([A-Z]{2})\b"
STATUS_ANYWHERE = r"\bStatus\b[^A-Za-z0-9]{0,5}([A-Z]{2})\b"

DEPARTING_BLOCK = r"(?is)\bDEPARTING:\s*.*?\bDate\s+\w{3}\s+([0-9]{1,2}\s+[A-Za-z]{3}\s+[0-9]{2,4})"
FLIGHT_DATE_TABLE = r"(?is)\bFlight\s+Date\b.*?\b(\d{2}\s+[A-Za-z]{3}\s+\d{2,4})\b"
DAY_MONTH_TOKEN = r"\b(\d{1,2}\s*(?:{months}))\b"
DATE_NEAR_CODE = r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"

# passports
SURNAME = r"(?i)\bSurname\b\s*[:#]?\s*([A-Z][A-Za-z \-]{2,60})"
GIVEN_NAMES = r"(?i)\b(Given Names|Given name|Forenames)\b\s*[:#]?\s*([A-Z][A-Za-z \-]{2,80})"
NATIONALITY = r"(?i)\bNationality\b\s*[:#]?\s*([A-Z]{3}|[A-Za-z ]{3,30})"
DATE_OF_EXPIRY = r"(?i)\b(Date of Expiry|Expiry Date|Date of expiration)\b\s*[:#]?\s*({forms})"

# --------------------------------------------------------------------------
# File names and report
# --------------------------------------------------------------------------
MISSING = "NA"
MAX_NAME_LENGTH = 180
DEFAULT_EXTENSION = ".pdf"
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1F]'
ERROR_SEPARATOR = " | "
REPORT_COLUMNS = [
    "path_in", "path_out", "top_class", "confidence", "invoice_number", "customer_name", "invoice_date",
    "total_value", "currency", "pnr", "passenger_name", "flight_number", "departure_date", "carrier",
    "surname", "given_names", "nationality", "date_of_expiry", "errors",
]
