"""Regular-expression helpers: one flag convention, single evaluation, offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# d: only \n ends a line; u/U: Unicode-aware case folding and \s \w \d \b.
_FLAGS = "(?duU)"
# Matches are folded into arrays in blocks of this size, see find_matches.
_BLOCK = 128


def unicode_regex(pattern: str) -> str:
    """The Java spelling of a Unicode-by-default pattern."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return _FLAGS + pattern


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Writing an expensive expression twice (``when(x != '', x)``) makes Spark
    run it twice; as the only element of an array it becomes a lambda variable.
    Unlike a helper column it stays inside ``coalesce``/``when``, so a cascade
    of patterns stops at the first hit.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_small_methods(value: Column, text: Column) -> Column:
    """``value``, in a projection whose code Spark cuts into small methods.

    In whole-stage code a projection of many expressions is one method, and the JVM never compiles a method
    of more than 8,000 bytes.  A projection that has a lambda is left out of whole-stage code, its expressions
    are generated as methods of bounded size, and those are compiled.  ``text`` is any non-NULL string of the row.
    """
    return F.when(F.forall(F.array(F.length(text)), lambda n: n >= 0), value)


# Stands for a match while a text is cut; texts that hold it are cut in another way.
_MARK = "\x01"


def split_by(text: Column, java: str) -> Column:
    """The stretches between the matches of a pattern.

    ``split`` compiles its pattern for every row, a replacement once for all.
    """
    quick = F.split(F.regexp_replace(text, java, _MARK), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, java, -1)).otherwise(quick)


def non_empty(value: Column) -> Column:
    """NULL instead of the empty string."""
    return bind(value, lambda v: F.when(v != "", v))


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern that cannot match nothing, or NULL."""
    return non_empty(F.regexp_extract(text, unicode_regex(pattern), 0))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, for groups that take part in every match."""
    return non_empty(F.regexp_extract(text, unicode_regex(pattern), group))


def first_groups(text: Column, pattern: str, **groups: int) -> Column:
    """Several groups of the same first match as a struct, or NULL.

    The text is searched once; the groups are then read off the (short) match.
    That re-match is exact because look-around in these patterns only sits at
    the two ends of a match, where the ends of the short string satisfy it too.
    """
    java = unicode_regex(pattern)
    return bind(
        F.regexp_extract(text, java, 0),
        lambda m: F.when(
            m != "", F.struct(*[F.regexp_extract(m, java, g).alias(n) for n, g in groups.items()])
        ),
    )


def count_matches(text: Column, pattern: str) -> Column:
    """Number of case-insensitive, non-overlapping matches."""
    return F.regexp_count(text, F.lit(unicode_regex("(?i)" + pattern)))


def contains_any(text: Column, words: list[str]) -> Column:
    """True if the text contains one of the words literally."""
    return text.rlike("|".join(re.escape(w) for w in words))


def find_matches(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """All matches as ``array<struct<start, match, before, after>>``.

    ``start`` counts characters from 0; ``before``/``after`` hold up to that
    many characters of context.  The gaps between the matches come from
    ``split``, the matches from ``regexp_extract_all``; one fold over both
    carries the running offset and the left context, so the work is linear in
    the text.  The fold appends to blocks of bounded size which are flattened
    at the end: appending to one ever longer array would copy it every time.
    """
    java = unicode_regex(pattern)
    gaps = split_by(text, java)
    if after:
        ahead = f"{_FLAGS}(?:{pattern})(?=((?s:.{{0,{after}}})))"
        groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern)) + 1
        afters = F.regexp_extract_all(text, F.lit(ahead), F.lit(groups))
    else:
        afters = F.array()

    def items(hits: Column) -> Column:
        pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))
        pairs = F.slice(pairs, F.lit(1), F.size(hits))
        return F.zip_with(
            pairs,
            afters,
            lambda p, a: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), F.coalesce(a, F.lit("")).alias("after")),
        )

    row = "struct<start:int,match:string,before:string,after:string>"
    state = f"struct<pos:int,ctx:string,done:array<array<{row}>>,out:array<{row}>>"

    def right(value: Column) -> Column:
        return F.right(value, F.lit(before)) if before else F.lit("")

    def fold_state(pos: Column, ctx: Column, done: Column, out: Column) -> Column:
        return F.struct(pos.alias("pos"), ctx.alias("ctx"), done.alias("done"), out.alias("out")).cast(state)

    def step(acc: Column, item: Column) -> Column:
        found = F.struct(
            (acc["pos"] + F.length(item["gap"])).alias("start"),
            item["hit"].alias("match"),
            right(F.concat(acc["ctx"], item["gap"])).alias("before"),
            item["after"].alias("after"),
        )
        return fold_state(
            acc["pos"] + F.length(item["gap"]) + F.length(item["hit"]),
            right(F.concat(acc["ctx"], item["gap"], item["hit"])),
            acc["done"],
            F.concat(acc["out"], F.array(found)),
        )

    def next_block(acc: Column, items: Column) -> Column:
        opened = fold_state(acc["pos"], acc["ctx"], F.concat(acc["done"], F.array(acc["out"])), F.array())
        return F.aggregate(items, opened, step)

    def in_blocks(items: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(items), F.lit(_BLOCK)),
            fold_state(F.lit(0), F.lit(""), F.array(), F.array()),
            lambda acc, s: next_block(acc, F.slice(items, s, F.lit(_BLOCK))),
            lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["out"]))),
        )

    hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    none = F.array().cast(f"array<{row}>")
    # Texts without a match, most of them, are done after one search.
    found = bind(hits, lambda h: F.when(F.size(h) > 0, bind(items(h), in_blocks)).otherwise(none))
    return F.when(text.isNotNull(), found)
