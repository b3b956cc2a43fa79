"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"^[A-Z][A-Z0-9_]*$"
#: Notes that get an emblem, and prefixes of configuration lines.
NOTES = {"Warning": "⚠️", "Tip": "💡", "Important": "❗", "Note": "📝", "Caveat": "🚧", "Mind": "🧠"}
CONFIG_PREFIXES = ("ALGO", "NBANDS", "NOMEGA", "EDIFF", "ISMEAR", "SIGMA", "LHFCALC", "LOPTICS", "ENCUT", "PREC", "LMAX", "NMAX")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` refers to it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clean(raw: Column) -> Column:
    """Page text: real line breaks, no formulas, single blanks, at most one empty line in a row."""
    s = F.replace(raw, F.lit("\\n"), F.lit("\n"))
    s = F.regexp_replace(s, r"(?s)\[math\].*?\[/math\]", "")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def title_key(title: Column) -> Column:
    """A title as it is compared: url-decoded (``+`` and a ``%`` that escapes nothing stay), blanks for underscores, lower case."""
    escaped = F.regexp_replace(F.replace(title, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.lower(strip(F.replace(F.coalesce(F.try_url_decode(escaped), title), F.lit("_"), F.lit(" "))))


def page_type(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(F.contains(t, F.lit("tutorial")), "tutorial")
        .when(F.contains(t, F.lit("how to")) | F.contains(t, F.lit("how-to")), "how_to")
        .when(F.contains(t, F.lit("best practices")) | F.contains(t, F.lit("best-practices")), "best_practices")
        .when(F.contains(t, F.lit("faq")), "faq")
        .when(F.contains(t, F.lit("pseudopotential")), "reference")
        .otherwise("other")
    )


def keyword_matches(keyword: str, text: Column) -> Column:
    """The keyword is in the text, or it has two words of letters at least and all of them are."""
    import re

    words = re.findall(r"[a-z]+", keyword)
    found = F.contains(text, F.lit(keyword))
    if len(words) > 1:
        every = F.lit(True)
        for w in words:
            every = every & F.contains(text, F.lit(w))
        found = found | every
    return found


def keyword_score(keyword: str, text: Column) -> Column:
    """100 equal, 50 contained, 70 all words, 10 for each word that is there."""
    import re

    words = re.findall(r"[a-z]+", keyword)
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) if len(words) > 1 else F.lit(0)
    return (
        F.when(text == keyword, 100)
        .when(F.contains(text, F.lit(keyword)), 50)
        .when(F.lit(len(words) > 1) & (hits == len(words)), 70)
        .otherwise(hits * 10)
        .cast("int")
    )


def reformat(raw: Column) -> Column:
    """A page for reading: emblems, steps and formulas marked up, and runs of configuration lines fenced."""
    s = F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    s = F.regexp_replace(s, r'(?s)Retrieved from ".*?"', "")
    for name, emblem in NOTES.items():
        s = F.replace(s, F.lit(f"\n{name}:"), F.lit(f"\n{emblem} **{name}:**"))
    s = F.regexp_replace(s, r"Step (\d+):", "\n**Step $1:**")
    s = F.regexp_replace(s, r"(?s)\[math\](.*?)\[/math\]", r"\$\$$1\$\$")
    bare = lambda x: strip(x)
    is_config = lambda x: (
        (F.contains(x, F.lit("=")) & ~F.startswith(x, F.lit("http")))
        | bare(x).startswith("!")
        | bare(x).rlike("^(" + "|".join(CONFIG_PREFIXES) + ")")
    )

    def fenced(lines: Column, flags: Column) -> Column:
        own = F.transform(
            lines,
            lambda x, i: F.concat(
                F.when(F.get(flags, i) & ((i == 0) | ~F.coalesce(F.get(flags, i - 1), F.lit(False))), F.lit("```\n")).otherwise(F.lit("")),
                F.when(~F.get(flags, i) & (i > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False)), F.lit("```\n")).otherwise(F.lit("")),
                x,
            ),
        )
        return F.concat(F.array_join(own, "\n"), F.when(F.element_at(flags, -1), F.lit("\n```")).otherwise(F.lit("")))

    out = bound(F.split(s, "\n", -1), lambda lines: bound(F.transform(lines, is_config), lambda flags: fenced(lines, flags)))
    out = F.regexp_replace(out, r"\n\s*\n\s*\n", "\n\n")
    return strip(F.replace(out, F.lit("\n```\n```"), F.lit("\n```\n")))


def html_title(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; pieces joined by a backslash and an n."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    pieces = F.filter(F.transform(F.split(s, r"<[^>]+>"), strip), lambda x: x != "")
    joined = F.array_join(pieces, "\\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        joined = F.replace(joined, F.lit(entity), F.lit(char))
    return joined


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """(start_index, chunk) of windows of ``size`` code points, ``size - overlap`` apart."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("start_index"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
