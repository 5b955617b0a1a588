"""Canonical tokens of formula text: words without meaning dropped, names spelled out, synonyms united.

Built-in expressions over token arrays.  Which words are dropped or replaced is
a parameter: a small default by LaTeX category below, or whole tables of the
user's own, read from a file (``sources.tables.word_table``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Font and size switches of plain LaTeX; they change how text looks.
FONTS = ["\\mathrm", "\\mathbf", "\\mathit", "\\mathsf", "\\mathtt", "\\textrm", "\\textbf", "\\textit", "\\rm", "\\bf", "\\it", "\\displaystyle", "\\textstyle"]
#: Delimiter sizes of plain LaTeX.
SIZES = ["\\left", "\\right", "\\big", "\\Big", "\\bigg", "\\Bigg"]
#: Spaces of plain LaTeX, all written as one.
SPACES = {w: ["\\space"] for w in ("\\,", "\\:", "\\;", "\\quad", "\\qquad")}
#: Operators that are typeset as their letters.
LETTERS = {"\\" + w: list(w) for w in ("sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min", "det")}
#: Two names of one sign.
SYNONYMS = {"\\leq": ["\\le"], "\\geq": ["\\ge"], "\\neq": ["\\ne"], "\\to": ["\\rightarrow"], "\\lbrack": ["["], "\\rbrack": ["]"], "\\dfrac": ["\\frac"], "\\tfrac": ["\\frac"]}


def canonical_tokens(items: Column, expanded: dict[str, list[str]], ignored: list[str]) -> Column:
    """Tokens without the ignored words, each word of ``expanded`` replaced by its tokens; null stays null."""
    kept = F.filter(items, lambda t: ~t.isin(ignored)) if ignored else items
    if not expanded:
        return kept
    table = F.create_map(*[x for w, out in expanded.items() for x in (F.lit(w), F.array(*map(F.lit, out)))])
    # Most tokens aren't in the table: a set test goes before the map's search.
    return F.flatten(F.transform(kept, lambda t: F.when(t.isin(list(expanded)), F.element_at(table, t)).otherwise(F.array(t))))


def without_angle_tokens(items: Column) -> Column:
    """Angle tokens dropped, angles cut off other tokens, ``\\:`` written ``:``."""
    plain = F.filter(items, lambda t: ~(t.startswith("[:") & t.endswith("]")))
    cut = F.transform(plain, lambda t: F.when(t.contains("[:") & t.endswith("]"), F.substring_index(t, "[:", 1)).otherwise(t))
    return F.transform(cut, lambda t: F.when(t == "\\:", ":").otherwise(t))


#: A group in curly brackets with up to two levels inside.
_GROUP = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def sub_before_sup(text: Column) -> Column:
    """Superscript and subscript of one base in canonical order: ``^ x _ y`` becomes ``_ y ^ x``; groups of up to three levels move whole."""
    part = rf"({_GROUP}|[^\s{{}}^_]+)"
    return F.regexp_replace(text, rf"\^ {part} _ {part}", r"_ $2 ^ $1")


def without_first_group(text: Column) -> Column:
    """Without a leading group in curly brackets (up to three levels) and the blanks around it."""
    return F.regexp_replace(text, rf"^\s*{_GROUP}\s*", "")


def unwrap(text: Column, commands: list[str], rounds: int = 3) -> Column:
    """``\\name{..}`` becomes its content, for the commands named; as many nested ones as there are rounds."""
    names = "|".join(commands)
    for _ in range(rounds):
        text = F.regexp_replace(text, rf"\\(?:{names})\s*\{{((?:[^{{}}]|{_GROUP})*)\}}", "$1")
    return text


def wrap_runs(text: Column, chars: str = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}", command: str = "text") -> Column:
    """Every run of the characters in ``\\text{..}``."""
    return F.regexp_replace(text, f"([{chars}]+)", rf"\\{command}{{$1}}")


def correct_words(items: Column, table: dict[str, str]) -> Column:
    """Tokens of the table replaced by its entry; an empty entry drops the token."""
    if not table:
        return items
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mended = F.transform(items, lambda t: F.when(t.isin(list(table)), F.element_at(found, t)).otherwise(t))
    return F.filter(mended, lambda t: t != "")


def correct_text(text: Column, table: list[tuple[str, str]], rounds: int = 4) -> Column:
    """Literal replacements in order, over and over up to ``rounds`` times, so that what one makes another can mend."""
    for _ in range(rounds):
        for old, new in table:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def arrow_command(text: Column) -> Column:
    """Text over and under an arrow as one command: ``\\underset{b}{\\overset{a}{\\rightarrow}}`` becomes ``\\xrightarrow[b]{a}``."""
    arrow = r"\\((?:left|right|leftright)arrow)"
    group = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
    both = F.regexp_replace(text, rf"\\underset\s*{group}\s*\{{\s*\\overset\s*{group}\s*\{{\s*{arrow}\s*\}}\s*\}}", r"\\x$3[$1]{$2}")
    over = F.regexp_replace(both, rf"\\overset\s*{group}\s*\{{\s*{arrow}\s*\}}", r"\\x$2{$1}")
    return F.regexp_replace(over, rf"\\underset\s*{group}\s*\{{\s*{arrow}\s*\}}", r"\\x$2[$1]{}")


def skip_rows(text: Column) -> Column:
    """Line breaks ``\\\\`` between ``\\begin{..}`` and ``\\end{..}`` written ``\\skip``, those outside left as they are."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\\begin\s*\{[^{}]*\}|\\end\s*\{[^{}]*\}|\\\\|(?s:.))"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p.startswith("\\begin"), 1).when(p.startswith("\\end"), -1).otherwise(0)
        piece = F.when((s["depth"] > 0) & (p == "\\\\"), "\\skip ").otherwise(p)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.concat(s["out"], piece).alias("out"))

    return F.aggregate(pieces, start, step)["out"]
