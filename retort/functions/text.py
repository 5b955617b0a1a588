"""Column functions on chemical markup and token sequences.

All are built-in Spark expressions.  A null input gives null, an empty one an
empty result, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens without content, and tokens that end a sequence.
SPECIAL = ["\\smear", "\\space"]
ENDS = ["<s>", "</s>"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Pieces between runs of blanks, tabs and line breaks."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda t: t != "")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def path_parts(path: Column) -> Column:
    """Folders and name of a path with either slash."""
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def base_name(path: Column) -> Column:
    """The name without folders and extension, and without a trailing ``-0-0-0``."""
    name = F.get(F.reverse(path_parts(path)), F.lit(0))
    return F.regexp_replace(F.regexp_replace(name, r"-0-0-0$", ""), r"\.[A-Za-z]+$", "")


def folder_split(split: Column, path: Column) -> Column:
    """The split in lower case without blanks, else the folder two above the name."""
    own = F.lower(F.trim(split))
    return F.coalesce(own, F.lower(F.get(F.reverse(path_parts(path)), F.lit(2))))


def drop_tokens(items: Column, unwanted: list[str]) -> Column:
    """Every occurrence of the unwanted tokens is left out; the rest keeps order and repeats."""
    return F.filter(items, lambda t: ~t.isin(unwanted))


def cut_at(items: Column, ends: list[str]) -> Column:
    """The tokens before the first of ``ends``; all of them where none occurs."""
    place = F.array_position(F.transform(items, lambda t: t.isin(ends)), True)
    return F.when(place > 0, F.slice(items, 1, (place - 1).cast("int"))).otherwise(items)


def without_angles(text: Column) -> Column:
    """Without angle attributes such as ``[:120]``."""
    return F.regexp_replace(text, r"\[:[0-9]*\]", "")


def unwrap_subscripts(items: Column) -> Column:
    """``_ { x }`` becomes ``x``: the pair ``_ {`` goes, and with it the next ``}``, whatever its nesting."""
    return let(items, _unwrapped)


def _unwrapped(items: Column) -> Column:
    n = F.size(items)
    ahead = F.zip_with(items, F.slice(items, 2, n), lambda t, after: F.struct(t.alias("t"), F.coalesce((t == "_") & (after == "{"), F.lit(False)).alias("opens")))
    # A brace is dropped where the token before it opened; only dropped places are collected.
    numbered = F.transform(ahead, lambda m, i: F.struct(m["t"].alias("t"), m["opens"].alias("opens"), i.alias("i")))
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<int>").alias("drop"))
    step = lambda s, m: (
        F.when(m["opens"], F.struct(F.lit(True).alias("open"), F.concat(s["drop"], F.array(m["i"], m["i"] + 1)).alias("drop")))
        .when(s["open"] & (m["t"] == "}"), F.struct(F.lit(False).alias("open"), F.concat(s["drop"], F.array(m["i"])).alias("drop")))
        .otherwise(s)
    )
    return let(F.aggregate(numbered, start, step)["drop"], lambda drop: F.filter(items, lambda t, i: ~F.array_contains(drop, i)))


def plain_bonds(text: Column) -> Column:
    """``--`` is written ``-:``, from left to right."""
    return F.replace(text, F.lit("--"), F.lit("-:"))


def without_color(text: Column) -> Column:
    """Without ``\\color{..}`` commands."""
    return F.regexp_replace(text, r"\\color\s*\{[^{}]*\}", "")


def tight_braces(text: Column) -> Column:
    """Without blanks on either side of curly brackets."""
    return F.regexp_replace(text, r" *([{}]) *", "$1")


def char_tokens(text: Column) -> Column:
    """The characters, those beyond ASCII as ``\\UC_`` and four hexadecimal digits (``\\LUC_`` and eight beyond U+FFFF)."""

    def one(c: Column) -> Column:
        wide = F.hex(F.encode(c, "UTF-32"))
        code = F.when(wide > F.lit("0000FFFF"), F.concat(F.lit("\\LUC_"), wide)).otherwise(F.concat(F.lit("\\UC_"), F.substring(wide, 5, 4)))
        return F.when(F.octet_length(c) > 1, code).otherwise(c)

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def chars_back(items: Column) -> Column:
    """The text of :func:`char_tokens`."""

    def one(t: Column) -> Column:
        digits = F.lpad(F.regexp_extract(t, r"_([0-9A-F]+)$", 1), 8, "0")
        return F.when(t.rlike(r"^\\L?UC_[0-9A-F]{4,8}$"), F.decode(F.unhex(digits), "UTF-32")).otherwise(t)

    return F.array_join(F.transform(items, one), "")


def markup_tokens(text: Column) -> Column:
    """Commands, escaped punctuation, coded characters and single characters, in order; blanks part tokens."""
    pattern = r"(\\UC_[0-9A-F]{4}|\\LUC_[0-9A-F]{8}|\\[A-Za-z]+|\\[^\sA-Za-z]|\S)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def bond_tokens(markup: Column) -> Column:
    """Hooks, bonds with their angle, branch brackets, commands and atoms of glued markup, in order."""
    pattern = (
        r"(\?\[[^\]]*\]|(?:<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?(?:\[[^\]]*\])?|branch[()]|\\[A-Za-z]+|[A-Z][a-z]?|[^\s])"
    )
    return F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))


def depth_range(text: Column) -> Column:
    """Struct of the lowest and the last depth of curly brackets (0 before the first)."""
    braces = F.split(F.regexp_replace(text, r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("lowest"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        now = s["last"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(F.least(s["lowest"], now).alias("lowest"), now.alias("last"))

    return F.aggregate(braces, start, step)


def balance_braces(text: Column) -> Column:
    """Struct of text, where unmatched ``}`` are dropped and missing ones appended, and whether it was bad."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("bad"))
    pieces = F.regexp_extract_all(text, F.lit(r"([{}]|[^{}]+)"), F.lit(1))

    def step(s: Column, c: Column) -> Column:
        stray = (c == "}") & (s["depth"] == 0)
        move = F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        kept = F.concat(s["out"], F.array(c))
        return F.when(stray, F.struct(s["depth"].alias("depth"), s["out"].alias("out"), F.lit(True).alias("bad"))).otherwise(
            F.struct((s["depth"] + move).alias("depth"), kept.alias("out"), s["bad"].alias("bad"))
        )

    done = lambda s: F.struct(
        F.concat(F.array_join(s["out"], ""), F.repeat(F.lit("}"), s["depth"])).alias("text"), (s["bad"] | (s["depth"] > 0)).alias("bad")
    )
    return F.aggregate(pieces, start, step, done)


def merge_single_chars(items: Column) -> Column:
    """Runs of two and more one-character tokens become one token; the first and the last token stay apart."""
    return let(items, _merged)


def _merged(items: Column) -> Column:
    n = F.size(items)
    alone = F.transform(items, lambda t, i: (F.length(t) == 1) & (i > 0) & (i < n - 1))
    begins = let(alone, lambda one: F.filter(F.transform(one, lambda o, i: F.when(~(o & (i > 0) & F.get(one, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull()))
    return let(begins, lambda s: F.transform(s, lambda at, j: F.array_join(F.slice(items, at + 1, F.coalesce(F.get(s, j + 1), n) - at), "")))


def wrap_brackets(items: Column) -> Column:
    """``(``, ``)`` and ``-`` in curly brackets, and the word ``branch`` left out of every token."""
    return F.transform(
        items,
        lambda t: F.replace(F.when(t.isin("(", ")", "-"), F.concat(F.lit("{"), t, F.lit("}"))).otherwise(t), F.lit("branch"), F.lit("")),
    )


def token_kind(token: Column) -> Column:
    """hook_start, hook_end, bond, branch_start, branch_end, bracket, angle or atom."""
    return (
        F.when(token.rlike(r"^\?\[[^,\]]*,"), "hook_end")
        .when(token.rlike(r"^\?\["), "hook_start")
        .when(token.rlike(r"^(<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?(\[|$)"), "bond")
        .when(token.isin("(", "branch("), "branch_start")
        .when(token.isin(")", "branch)"), "branch_end")
        .when(token.isin("{", "}"), "bracket")
        .when(token.rlike(r"^\[:"), "angle")
        .otherwise("atom")
    )
