"""Scores for many rules: an inverted index from pieces of text to rules, and an equi-join.

Rules in expressions (``classify.score``) cost every document a look for every rule.  With thousands of rules
nearly all of them have nothing to do with a document.  Here rules stay a table:

1. Every literal (keyword or phrase) is listed under one of its grams of GRAM characters, the one that the
   fewest literals have; keywords that tolerate an edit, also under a gram of each piece of which one must have survived.
2. A document's distinct grams meet the index in an equi-join; what meets are the rules that may hit.
   Of all pairs of a document and a rule only those become rows, each of them once.  Of the grams of up to LISTED_GRAMS entries
   one pattern is made, and a text is walked for these; of more, every stretch of a text is one to look up.
3. They are counted exactly where they meet, beside the text.  What is not literally there but
   listed under a piece is compared with the windows of the text around such pieces.
4. Without near matches, many literals are counted in one walk of a pattern instead (``_Walk``): what it reports joins
   a table of points, and the text is not searched for each.
5. Only sums are shuffled, one small row for each document and task: neither texts nor pairs leave their task.

The index is broadcast in blocks of bounded length, a pass over the texts each.  Nothing of the rules comes to the driver
otherwise but the classes' names, the patterns of regular expressions, which have no pieces and stay expressions, and
grams for that one pattern; all are few and their numbers are checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.fuzzy import similar_enough, text_inside_keyword
from doctriage.functions.multi import FEW, Literals
from doctriage.functions.regex import bind, count_matches
from doctriage.functions.text import normalize_text, text_or_empty
from doctriage.sources.rules import MAX_RULES, Rules
from doctriage.sources.shared import materialize

#: Characters of a gram.  Longer ones meet fewer rules that a text doesn't hold; shorter words are listed under themselves.
GRAM = 4
#: Rules that a pass over the texts looks for; each further block is another pass.
RULES_IN_BLOCK = 20_000
#: Entries of the index whose grams one pattern looks for.
LISTED_GRAMS = 10_000
#: Literals, with what tells of their overlaps, that one pattern counts in a walk; characters of the longest of them.
WALKED_WORDS, WALKED_CHARS = 10_000, 64
#: Stands before a word in the entries that take overlapping places off again, and between literals that are given as one text.
_OVERLAP, _BETWEEN = "\x02", "\x03"
#: The entry that every text is listed under, and what stands before the grams of tiny texts; neither is as long as a gram.
_EVERY, _TINY = "", "\x01" * GRAM


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct stretches of ``size`` characters of a text."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(found)


def _needed(n: Column, w: Column) -> Column:
    """Smallest LCS with 2 * LCS / (n + w) > 0.9."""
    return F.floor(F.lit(9) * (n + w) / F.lit(20)).cast("int") + 1


def _pieces(word: Column, count: Column) -> Column:
    """The word cut into ``count`` pieces as equal as can be: array<struct<at, piece>>."""
    n = F.length(word)
    cut = lambda i: F.floor(n * i / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(cut(i).alias("at"), F.substr(word, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))


def _quoted(piece: Column) -> Column:
    return F.regexp_replace(piece, r"([^\p{L}\p{N}\s])", r"\\$1")


#: Stands around a text where windows are cut; normalised texts don't hold it.
_OUTSIDE = "\n"


def _window_patterns(word: Column, edits: Column) -> Column:
    """For each piece a pattern that captures, wherever a text holds it, the stretch that has all windows it may be in.

    A window that is similar enough keeps one of 2 * edits + 1 pieces, shifted by ``edits`` characters at most: the stretch is longer than the
    word by as many at both sides.  Only the piece's first character is consumed, so that overlapping pieces are all seen.
    """
    n = F.length(word)

    def around(p: Column) -> Column:
        size, before = (n + 2 * edits).cast("string"), (p["at"] + edits + 1).cast("string")
        first, rest = _quoted(F.left(p["piece"], F.lit(1))), _quoted(F.substr(p["piece"], F.lit(2)))
        pattern = F.concat(F.lit("(?s)"), first, F.lit("(?="), rest, F.lit(")(?<=(?=(.{"), size, F.lit("})).{"), before, F.lit("})"))
        return F.struct(p["piece"].alias("piece"), pattern.alias("pattern"))

    return F.transform(_pieces(word, 2 * edits + 1), around)


def literal_rules(rules_table: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(rule, class, word, weight, times, near, edits, end_edits, windows) of keywords and phrases; ``rule`` tells them apart.

    ``near``: whether the word counts where a text only resembles it; ``edits``: characters that a window inside a text may
    miss; ``end_edits``: edits at an end of a text.  Rules of the same class, kind and word are one that counts ``times`` times.
    """
    keyword = F.col("kind") == "keyword"
    literals = (
        rules_table.where(F.col("kind").isin("keyword", "phrase") & F.col("pattern").isNotNull())
        .groupBy("class", "kind", F.lower("pattern").alias("word"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    n, near = F.length("word"), keyword & (F.col("word") != "") & F.lit(fuzzy)
    sizes = F.sequence(F.floor(n / 2).cast("int"), F.greatest(n - 1, F.floor(n / 2).cast("int")))
    at_ends = F.transform(sizes, lambda w: F.when((w < n) & (w >= _needed(n, w)), n + w - 2 * _needed(n, w)).otherwise(0))
    sized = literals.withColumns(
        {
            "weight": F.when(keyword, fixed.KEYWORD_WEIGHT).otherwise(fixed.PHRASE_WEIGHT),
            "near": near,
            "edits": F.when(near, n - _needed(n, n)).otherwise(0).cast("int") if fuzzy else F.lit(0),
            "end_edits": F.when(near, F.array_max(at_ends)).otherwise(0).cast("int") if fuzzy else F.lit(0),
        }
    )
    patterns = F.when(F.col("edits") > 0, _window_patterns(F.col("word"), F.col("edits")))
    if not fuzzy:
        patterns = F.lit(None).cast("array<struct<piece:string,pattern:string>>")
    return sized.withColumn("rule", F.xxhash64("class", "kind", "word")).withColumn("windows", patterns).drop("kind")


def rule_index(literals: DataFrame) -> DataFrame:
    """(gram, rule): each literal under its rarest gram, and under one of every piece that an edited form keeps.

    Words shorter than a gram are listed under themselves.
    """
    word = F.col("word")
    ways = F.array(F.lit(1), 2 * F.col("edits") + 1, F.col("end_edits") + 1)
    cut = F.flatten(F.transform(F.array_distinct(ways), lambda count: F.transform(_pieces(word, count), lambda p: p["piece"])))
    pieces = literals.where(word != "").select("rule", F.explode(F.array_distinct(cut)).alias("piece"))
    own = F.when(F.length("piece") >= GRAM, grams(F.col("piece"))).otherwise(F.array("piece"))
    listed = pieces.select("rule", "piece", F.explode(own).alias("gram"))
    sizes = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("others"))
    rarest = listed.join(sizes, "gram").groupBy("rule", "piece").agg(F.min(F.struct("others", "gram")).alias("best"))
    return rarest.select("rule", F.col("best.gram").alias("gram")).distinct()


def _near(norm: Column, rule: Column) -> Column:
    """Whether a text that does not hold the rule's keyword resembles it somewhere by more than 0.9."""
    word, n, m = rule["word"], F.length(rule["word"]), F.length(norm)

    def foreign(part: Column) -> Column:
        return F.length(F.call_function("translate", part, word, F.lit("")))

    def similar(window: Column) -> Column:
        # At most so many characters of a window can be foreign to the word; this rules most out.
        close = 20 * (F.length(window) - foreign(window)) > 9 * (n + F.length(window))
        return F.when(close, similar_enough(word, window)).otherwise(F.lit(False))

    def holds(stretch: Column) -> Column:
        within = lambda w: ~F.contains(w, F.lit(_OUTSIDE)) & similar(w)
        any_window = F.exists(F.sequence(F.lit(1), 2 * rule["edits"] + 1), lambda i: within(F.substr(stretch, i, n)))
        # A window leaves out 2 * edits characters, and no more than its own edits can be foreign.
        return F.when(foreign(stretch) <= 3 * rule["edits"], any_window).otherwise(F.lit(False))

    def search(pieces: Column) -> Column:
        beyond = F.repeat(F.lit(_OUTSIDE), n + rule["edits"])
        found = lambda text, p: F.regexp_extract_all(text, p["pattern"], F.lit(1))
        anywhere = bind(F.concat(beyond, norm, beyond), lambda text: F.exists(pieces, lambda p: F.exists(found(text, p), holds)))
        return F.when(F.size(pieces) > 0, anywhere)

    # A piece that a text doesn't hold needs no pattern.
    kept = F.filter(rule["windows"], lambda p: F.contains(norm, p["piece"]))
    inside = F.coalesce(F.when(rule["edits"] > 0, bind(kept, search)), F.lit(False))
    sizes = F.filter(F.sequence(F.floor(n / 2).cast("int"), n - 1), lambda w: w >= _needed(n, w))
    at_ends = F.exists(sizes, lambda w: similar(F.left(norm, w)) | similar(F.right(norm, w)))
    return F.when(m <= n, text_inside_keyword(norm, word)).otherwise(F.lit(False)) | F.when(m >= n, inside | at_ends).otherwise(F.lit(False))


def _points(norm: Column, rule: Column, fuzzy: bool) -> Column:
    """What one rule gives a text."""
    removed = F.octet_length(norm) - F.octet_length(F.replace(norm, rule["word"], F.lit("")))
    hits = (removed / F.octet_length(rule["word"])).cast("double")
    points = F.when(F.contains(norm, rule["word"]), hits * rule["weight"])
    if fuzzy:  # A lambda would keep the counting out of generated code.
        points = points.when(F.when(rule["near"], _near(norm, rule)).otherwise(F.lit(False)), F.lit(fixed.FUZZY_BOOST))
    return rule["times"] * points.otherwise(F.lit(0.0))


def _tiny_grams(norm: Column) -> Column:
    """What a text no longer than a keyword is listed under: grams of its own length, of GRAM characters at most."""
    return F.coalesce(*[F.when(F.length(norm) == s, F.array(norm)) for s in range(1, GRAM)], grams(norm))


def _tiny_index(literals: DataFrame) -> DataFrame:
    """(gram, rule): keywords that a tiny text may resemble a part of, under all their grams of each size."""
    sizes = range(1, GRAM + 1)
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("word"), s) for s in sizes])))
    return literals.where("near").select("rule", F.explode(every).alias("gram"))


def _grams_to_look_up(norm: Column, literals: DataFrame, sizes: list[int]) -> Column:
    """The distinct grams of a text that the index may have: those that it has, if they fit in one pattern, or all of its sizes.

    Shorter grams that a found one begins with are found with it.
    """
    if not sizes:
        return F.array().cast("array<string>")
    rows = literals.select(F.explode("grams").alias("gram")).limit(LISTED_GRAMS + 1).collect()
    if len(rows) > LISTED_GRAMS:
        return F.concat(*[grams(norm, s) for s in sizes])
    found = Literals(r["gram"] for r in rows).held(norm)
    return F.array_distinct(F.flatten(F.transform(found, lambda g: F.array(*[F.left(g, F.lit(s)) for s in sizes]))))


def _overlapped(word: str) -> list[str]:
    """What a text holds where the word begins again inside itself."""
    return [word + word[b:] for b in range(1, len(word)) if word.endswith(word[:b])]


class _Walk:
    """Literals that are counted in one walk over a text.

    One pattern reports the longest of them at every place of a text, which tells of all it begins with. Places where a word overlaps itself are
    no hits, but count only where the text holds such a stretch; these are literals of the walk too, and a text with one of them is counted again.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.literals = Literals([*words, *(e for w in words for e in _overlapped(w))])
        known = set(words)
        self.begins = [(x, x[:n]) for x in self.literals.words for n in range(1, len(x) + 1) if x[:n] in known]
        self.again = [(x, w) for x, w in self.begins if any(x.startswith(e) for e in _overlapped(w))]

    def found(self, norm: Column) -> Column:
        """The entries of a text, one for every hit and one for every place too many: array<string>."""
        hits = F.regexp_extract_all(norm, F.lit(self.literals.pattern), F.lit(1))
        if not self.again:
            return hits
        texts, words = (F.split(F.lit(_BETWEEN.join(pair[i] for pair in self.again)), _BETWEEN) for i in (0, 1))

        def too_many(found: Column, word: Column) -> Column:
            places = F.size(F.filter(found, lambda x: F.startswith(x, word)))
            removed = F.octet_length(norm) - F.octet_length(F.replace(norm, word, F.lit("")))
            return F.array_repeat(F.concat(F.lit(_OVERLAP), word), places - (removed / F.octet_length(word)).cast("int"))

        def again(found: Column, held: Column) -> Column:
            own = F.filter(F.arrays_zip(texts.alias("x"), words.alias("w")), lambda p: F.array_contains(held, p["x"]))
            return F.flatten(F.transform(F.array_distinct(F.transform(own, lambda p: p["w"])), lambda w: too_many(found, w)))

        none = F.array().cast("array<string>")
        return bind(hits, lambda found: F.concat(found, bind(F.array_intersect(found, texts), lambda held: F.when(F.size(held) > 0, again(found, held)).otherwise(none))))

    def entries(self, literals: DataFrame) -> DataFrame:
        """(gram, class, points): what each entry gives."""
        ways = [(x, w, "1") for x, w in self.begins] + [(_OVERLAP + w, w, "-1") for w in sorted({w for _, w in self.again})]
        given = F.lit(_BETWEEN.join(part for way in ways for part in way))  # in the plan: no task makes them from Python's objects
        parts = literals.sparkSession.range(1).select(F.split(given, _BETWEEN).alias("parts"))
        places = F.sequence(F.lit(0), F.size("parts") - 3, F.lit(3))
        rows = parts.select("parts", F.explode(places).alias("i")).select(
            F.get("parts", F.col("i")).alias("gram"), F.get("parts", F.col("i") + 1).alias("word"), F.get("parts", F.col("i") + 2).cast("int").alias("sign")
        )
        found = literals.join(F.broadcast(rows), "word")
        return found.groupBy("gram", "class").agg(F.sum(F.col("sign") * F.col("weight") * F.col("times")).alias("points"))


def _walked(literals: DataFrame, rules: int) -> tuple[_Walk | None, bool]:
    """The walk for the literals, and whether it has all of them; none for few of them, or for more than one pattern takes."""
    if not FEW < rules <= WALKED_WORDS:
        return None, False
    rows = literals.where(_lettered()).select("word", _may_walk().alias("short")).collect()
    words = {r["word"] for r in rows if r["short"]}
    walk = _Walk([*words]) if len(words) > FEW else None
    if walk is None or len(walk.literals.words) > 2 * WALKED_WORDS:
        return None, False
    return walk, all(r["short"] for r in rows)


def _lettered() -> Column:
    """A word without letters has no grams."""
    return F.col("grams").isNotNull()


def _may_walk() -> Column:
    marks = F.contains("word", F.lit(_OVERLAP)) | F.contains("word", F.lit(_BETWEEN))
    return _lettered() & (F.length("word") <= WALKED_CHARS) & ~marks


def _class_names(rules_table: DataFrame) -> list[str]:
    """Classes in rule order, the built-in ones that the table doesn't have last."""
    rows = rules_table.groupBy("class").agg(F.min("class_ord").alias("place")).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rules table may have {MAX_RULES} classes at most")
    names = [r["class"] for r in sorted(rows, key=lambda r: r["place"])]
    return names + [c for c in fixed.BUILTIN_CLASSES if c not in names]


def _first_meeting(norm: Column, tiny: Column) -> Column:
    """Of all the grams under which a text meets a rule, the one that counts: the first of the rule's list that the text
    holds or, if it holds none, the first of a tiny text's that the keyword holds."""
    held = lambda grams: F.exists(grams, lambda g: F.contains(norm, g))
    listed = F.when(F.col("place") > 0, ~held(F.slice("grams", F.lit(1), F.col("place")))).otherwise(F.lit(True))
    own = F.get(F.filter(_tiny_grams(norm), lambda g: F.contains(F.col("word"), g)), F.lit(0))
    of_tiny = tiny & ~held(F.col("grams")) & (F.concat(F.lit(_TINY), own) == F.col("gram"))
    return F.when(F.col("place") >= 0, listed).otherwise(of_tiny)


def score_by_index(
    df: DataFrame, rules_table: DataFrame, text: str = "text", keys: tuple[str, ...] = ("path",), fuzzy: bool = True
) -> DataFrame:
    """Scores in long form, (keys, class_ord, class, score), one row per document and class, for rules tables of any length.

    Equal to ``classify.score_by_table``.  Rows are told apart by their keys and text, and
    repeated rows are kept.  NULL texts are empty.
    """
    names = _class_names(rules_table)
    literals = literal_rules(rules_table, fuzzy)
    index = rule_index(literals)
    regexes = {c.name: c.regexes for c in Rules.from_table(rules_table.where("kind = 'regex'")).usable(df.sparkSession).classes}
    raw = text_or_empty(F.col(text))
    by_regex = {n: [(f"_regex_{i}_{j}", p, w) for j, (p, w) in enumerate(regexes.get(n, ()))] for i, n in enumerate(names)}
    counts = [(count_matches(raw, p).cast("double") * F.lit(w)).alias(c) for found in by_regex.values() for c, p, w in found]

    places = index.groupBy("rule").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    literals = materialize(literals.join(places, "rule", "left"), "rules")
    known = literals.agg(
        F.count(F.lit(1)).alias("rules"),
        F.coalesce(F.max(F.when(F.col("near"), F.length("word"))), F.lit(0)).alias("longest"),
        F.collect_set(F.array_distinct(F.transform("grams", lambda g: F.length(g)))).alias("sizes"),
        # A word without letters is between all characters.
        F.collect_list(F.when(F.col("word") == "", F.struct("class", (F.col("weight") * F.col("times")).alias("weight")))).alias("empty"),
    ).first()
    empty: dict[str, float] = {}
    for r in known["empty"]:
        empty[r["class"]] = empty.get(r["class"], 0.0) + r["weight"]
    longest, sizes = known["longest"] if fuzzy else 0, sorted({n for found in known["sizes"] for n in found})

    norm = F.col("norm")
    docs = df.select(*keys, F.xxhash64(raw).alias("doc"), normalize_text(F.col(text)).alias("norm"), *counts)
    kept = [*keys, "doc", *[c for found in by_regex.values() for c, _, _ in found]]
    parts = []
    # Words with near matches need the text anyway.
    walk, alone = (None, False) if fuzzy else _walked(literals, known["rules"])
    if walk:
        entries = walk.entries(literals.where(_may_walk()))
        literals = literals.where(~_may_walk())
        words = docs.select(*kept, F.length(norm).alias("_chars"), "norm").withColumn("gram", F.explode(F.concat(F.array(F.lit(_EVERY)), walk.found(norm))))
        parts.append(words.join(F.broadcast(entries), "gram", "left").select(
            *kept, F.col("class").alias("_class"), F.col("points").alias("_points"), "_chars", F.when(F.col("gram") == _EVERY, int(alone)).otherwise(0).alias("_row"),
        ))
    # Words and pieces shorter than a gram are looked for by grams of their own length, if there are any.
    listed = [F.array(F.lit(_EVERY)), *([_grams_to_look_up(norm, literals, sizes)] if not alone else [])]
    if longest:
        tiny = F.transform(_tiny_grams(norm), lambda g: F.concat(F.lit(_TINY), g))
        listed.append(F.when(F.length(norm).between(1, longest), tiny).otherwise(F.array().cast("array<string>")))
    exploded = docs.withColumn("gram", F.explode(F.concat(*listed)))
    blocks = max(1, -(-known["rules"] // RULES_IN_BLOCK)) if not alone else 0
    for block in range(blocks):
        own = literals.where((F.pmod("rule", F.lit(blocks)) == block) & F.col("grams").isNotNull())
        entries = own.select(F.posexplode("grams").alias("place", "gram"), "rule")
        if longest:
            entries = entries.unionByName(_tiny_index(own).select(F.lit(-1).alias("place"), F.concat(F.lit(_TINY), "gram").alias("gram"), "rule"))
        # The entry that every text meets, so that one without a rule has a row.
        entries = entries.unionByName(df.sparkSession.range(1).select(F.lit(-1).alias("place"), F.lit(_EVERY).alias("gram"), F.lit(None).cast("bigint").alias("rule")))
        met = exploded.join(F.broadcast(entries), "gram").join(F.broadcast(own), "rule", "left")
        if fuzzy:  # Otherwise a rule has one gram and is met once.
            met = met.where((F.col("gram") == _EVERY) | _first_meeting(norm, F.lit(bool(longest))))
        parts.append(met.select(
            *kept,
            F.col("class").alias("_class"),
            F.when(F.col("rule").isNotNull(), _points(norm, F.struct("word", "weight", "times", "near", "edits", "windows"), fuzzy)).alias("_points"),
            F.length(norm).alias("_chars"),
            F.when(F.col("gram") == _EVERY, 1 if block == 0 else 0).otherwise(0).alias("_row"),
        ))
    rows = reduce(DataFrame.unionByName, parts)
    # Repeated rows meet here: as many rows go on, and each has its share of the points, which are multiples of a half.
    sums = [F.sum(F.when(F.col("_class") == n, F.col("_points"))).alias(f"_points_{i}") for i, n in enumerate(names)]
    counted = rows.groupBy(*kept).agg(F.sum("_row").cast("int").alias("_rows"), F.max("_chars").alias("_chars"), *sums)

    def total(i: int, name: str) -> Column:
        out = F.coalesce(F.col(f"_points_{i}") / F.col("_rows"), F.lit(0.0))
        if name in empty:
            out = out + (F.col("_chars") + 1) * F.lit(empty[name])
        for column, _, _ in by_regex[name]:
            out = out + F.col(column)
        return out

    totals = [F.struct(F.lit(i).alias("class_ord"), F.lit(n).alias("class"), total(i, n).alias("score")) for i, n in enumerate(names)]
    return counted.select(*keys, F.explode(F.array_repeat(F.array(*totals), F.col("_rows"))).alias("_totals")).select(*keys, F.inline("_totals"))
