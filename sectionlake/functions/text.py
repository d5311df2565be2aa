"""Text expressions: normalising, folding, tokenising, globs, lines and summaries, all as Spark columns."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
#: The signs that str.splitlines ends a line at.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space as str.split and str.strip see it.
SPACE = "[\\s\x0b\x1c-\x1f\x85\\p{Z}]"


def normalise(text: Column) -> Column:
    """Drop runs of - _ . at the start and then at the end of tokens: --no-cache is no-cache, 3.12 stays."""
    # The first look ahead is there for speed: at any other sign the match fails at once.
    lead = F.regexp_replace(text, rf"(?=[-_.])(?<![{WORD}.\-])[-_.]+(?=[{WORD}])", "")
    return F.regexp_replace(lead, rf"(?=[-_.])(?<=[{WORD}])[-_.]+(?![{WORD}.\-])", "")


@functools.cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that decompose, and their base letters."""
    marked = [chr(c) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.normalize("NFD", chr(c))[0] != chr(c)]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(text: Column) -> Column:
    """Latin letters without their diacritics."""
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, *_accents())).otherwise(text)


def query_tokens(text: Column) -> Column:
    """The words of a query, in order and with repeats: they start with a letter or digit and keep inner - _ ."""
    found = F.regexp_extract_all(normalise(F.lower(text)), F.lit(rf"[\p{{L}}\p{{N}}][{WORD}.\-]*"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[._\-]+|[._\-]+$", "")), lambda t: t != "")


def index_tokens(text: Column) -> Column:
    """The tokens of indexed text: runs of letters, digits, private-use signs and - _ . in folded lower case."""
    return F.regexp_extract_all(fold(F.lower(normalise(text))), F.lit(r"[\p{L}\p{N}\p{Co}._\-]+"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z alone."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def collapse(text: Column) -> Column:
    """Words joined by one space."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text as str.splitlines gives them: no last empty one, none for an empty text."""
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def glob_pattern(glob: str) -> str:
    """A case-sensitive glob as an anchored regular expression: * and ? cross /, [a-z] and [^x] are classes."""
    out, at = [], 0
    while at < len(glob):
        sign = glob[at]
        at += 1
        if sign == "*":
            out.append(".*")
        elif sign == "?":
            out.append(".")
        elif sign == "[":
            body = at + (glob[at : at + 1] == "^")
            end = glob.find("]", body + 1)
            if end < 0:
                return r"(?!)"  # an open class matches nothing
            inside = glob[body:end]
            out.append("[" + ("^" if body > at else "") + re.sub(r"([\\\[\]&^~])", r"\\\1", inside) + "]")
            at = end + 1
        else:
            out.append(re.escape(sign))
    return r"(?s)\A" + "".join(out) + r"\z"


class FilterError(ValueError):
    """A path filter that isn't a non-empty string."""


def path_filter(path: Column, globs: list[str] | None) -> Column | None:
    """The rows under any of the globs; a plain entry also stands for the folder of that name. None: no filter.

    Plain entries become equality and prefix tests, which Parquet scans can use; others a pattern.
    """
    if not globs:
        return None
    out = F.lit(False)
    for glob in globs:
        if not isinstance(glob, str) or not glob:
            raise FilterError(f"invalid path filter {glob!r}")
        if any(c in glob for c in "*?["):
            head = re.split(r"[*?\[]", glob, maxsplit=1)[0]
            out = out | (path.startswith(head) & path.rlike(glob_pattern(glob)))
        else:
            out = out | (path == glob) | path.startswith(glob.rstrip("/") + "/")
    return out


def prefix_filter(path: Column, prefix: str) -> Column:
    """Paths that start with the prefix, A to Z in either case."""
    upper = "".join(map(chr, range(65, 91)))
    return ascii_lower(path).startswith(prefix.translate(str.maketrans(upper, upper.lower())))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def first_sentence(body: Column) -> Column:
    return F.element_at(F.split(body, r"(?<=[.!?])\s", 2), 1)


def summary_body(text: Column) -> Column:
    """A section's prose: lines that aren't headings or blank, white space collapsed."""
    kept = F.filter(lines(text), lambda x: ~x.startswith("#") & (strip(x) != ""))
    return collapse(F.array_join(kept, "\n"))


def summary_line(title: Column, bodies: Column) -> Column:
    """Title and first sentence of the first body of 20 characters that is no table or fence, in 160 characters."""
    fit = F.filter(bodies, lambda b: (F.length(b) >= 20) & ~b.startswith("|") & ~b.startswith("```"))
    first = F.coalesce(first_sentence(F.get(fit, F.lit(0))), F.lit(""))
    whole = F.when((first != "") & (F.lower(first) != F.lower(title)), F.concat(title, F.lit(" · "), first)).otherwise(title)
    return F.when(F.length(whole) > 160, F.concat(F.substring(whole, 1, 157), F.lit("…"))).otherwise(whole)
