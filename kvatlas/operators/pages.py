"""Documentation pages: parsing into key pages and other pages, duplicates, and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvatlas.functions import text as T

#: Pages that describe files, not keys.
FILE_PAGES = (
    "ABCAR", "ABNCAR", "BSEFATBAND", "CHG", "CHGCAR", "CONTCAR", "DOSCAR", "DYNMATFULL", "EIGENVAL", "ELFCAR",
    "FFCAR", "FFNCAR", "GAMMA", "HESSEMAT", "HILLSPOT", "HISCAR", "IBZKPT", "ICONST", "INCAR", "IRCCAR", "KPOINTS",
    "KPOINTS_ELPH", "KPOINTS_OPT", "LOCPOT", "ML_AB", "ML_ABN", "ML_EATOM", "ML_FF", "ML_FFN", "ML_HEAT", "ML_HIS",
    "ML_LOGFILE", "ML_REG", "MP2", "NICS", "NMRCURBX", "OSZICAR", "OUTCAR", "PARCHG", "PCDAT", "PENALTYPOT", "POSCAR",
    "POSNICS", "POT", "POTCAR", "PROCAR", "PROCAR_OPT", "PROJCAR", "PROOUT", "QPOINTS", "REGCAR", "REPORT", "STOPCAR",
    "TAUCAR", "TMPCAR", "UIJKL", "VIJKL", "WANPROJ", "WAVECAR", "WAVEDER", "XDATCAR",
)
#: What ends a description, and what ends the list of related keys.
DESCRIPTION_ENDS = ("output", "recommendation", "related", "examples", "references", "retrieved", "learn", "subcategor")
RELATED_ENDS = ("Examples", "References", "Retrieved")


def _first(lines: Column, test) -> Column:
    """Index from 0 of the first line that passes, else null."""
    at = F.transform(lines, lambda x, i: F.when(test(x, i), i))
    return F.array_min(F.array_compact(at))


def key_pages(pages: DataFrame) -> DataFrame:
    """TAG rows (without auto_generated) of the pages that define a key.

    The title is an identifier; the first line starts with a capital; one of the first ten lines is the key's
    definition; and some line has a description or default. The default is the last one given, and related
    keys are read up to the examples, references or retrieval note.
    """
    lines = F.filter(F.transform(F.split(T.clean(F.coalesce("content", F.lit(""))), "\n"), T.strip), lambda x: x != "")
    rows = pages.where(F.col("title").rlike(T.IDENTIFIER))
    # lines are split once a page: what is looked for in them gets them as a lambda's variable
    own = F.inline(F.transform(F.filter(F.array(lines), _defines_key), _key_fields))
    return rows.select("page_idx", "title", own, F.coalesce("url", F.lit("")).alias("url"))


def _defines_key(lines: Column) -> Column:
    defines = lambda x: x.startswith("= ") | x.startswith("=.") | (x == F.concat(F.col("title"), F.lit("=")))
    first_char = F.substring(F.get(lines, F.lit(0)), 1, 1)
    return (
        (F.size(lines) > 0)
        & (first_char == F.upper(first_char))
        & (first_char != F.lower(first_char))
        & F.exists(F.slice(lines, 1, 10), defines)
        & F.exists(lines, lambda x: F.lower(x).rlike(r"(description|descprition|definition|default)\s*:"))
    )


def _key_fields(lines: Column) -> Column:
    """value, default, description, related of a key's page."""
    value = F.get(F.filter(lines, lambda x: x.startswith("=") & (F.length(x) > 1)), F.lit(0))
    after = lambda i: F.coalesce(F.get(lines, i + 2), F.lit(""))
    defaults = F.array_compact(
        F.transform(lines, lambda x, i: F.when(F.lower(x).startswith("default:") & after(i).startswith("="), T.strip(F.substring(after(i), 2, 1 << 30))))
    )
    ends = lambda x: F.lower(x).rlike("^(" + "|".join(DESCRIPTION_ENDS) + ")")

    def description(at: Column) -> Column:
        opening = T.strip(F.regexp_extract(F.get(lines, at), r"(?s)^[^:]*:(.*)$", 1))
        end = _first(lines, lambda x, i: (i > at) & ends(x))
        size = F.coalesce(end, F.size(lines)) - at - 1
        body = F.array_join(F.slice(lines, at + 2, F.greatest(size, F.lit(0))), " ")
        return F.when(at.isNotNull(), T.strip(F.concat_ws(" ", opening, body))).otherwise("")

    def related(at: Column) -> Column:
        end = _first(lines, lambda x, i: (i > at) & x.rlike("^(" + "|".join(RELATED_ENDS) + ")"))
        span = F.coalesce(end, F.size(lines)) - at - 1
        listed = F.filter(F.slice(lines, at + 2, F.greatest(span, F.lit(0))), lambda x: x.rlike(T.IDENTIFIER))
        return F.when(at.isNotNull(), F.array_distinct(listed)).otherwise(F.array().cast("array<string>"))

    return F.struct(
        F.coalesce(T.strip(F.substring(value, 2, 1 << 30)), F.lit("")).alias("value"),
        F.coalesce(F.try_element_at(defaults, F.lit(-1)), F.lit("")).alias("default"),
        T.bound(_first(lines, lambda x, i: F.lower(x).rlike(r"^(description|descprition|definition)\s*:")), description).alias("description"),
        T.bound(_first(lines, lambda x, i: F.lower(x).startswith("related tags and articles")), related).alias("related"),
    )


def other_pages(pages: DataFrame, file_pages: tuple[str, ...] = FILE_PAGES, least: int = 50, summary: int = 1000) -> DataFrame:
    """NON_TAG rows of the pages that don't define a key and hold ``least`` characters at least."""
    title = F.coalesce("title", F.lit(""))  # a page without title isn't dropped
    is_file = title.isin(*file_pages)
    rows = pages.withColumn("title", title).where((~title.rlike(T.IDENTIFIER) | is_file) & (F.length("content") >= least))
    return rows.select(
        "page_idx",
        "title",
        T.page_type(F.col("title")).alias("type"),
        T.strip(F.substring(T.clean(F.col("content")), 1, summary)).alias("summary"),
        "url",
        is_file.alias("is_file_page"),
    )


def skipped_titles(pages: DataFrame) -> DataFrame:
    return pages.select("title").join(key_pages(pages).select("title"), "title", "left_anti")


def first_by_title(pages: DataFrame) -> DataFrame:
    """One page for each title: the first in file order."""
    rest = [c for c in pages.columns if c != "title"]
    best = pages.groupBy("title").agg(F.min_by(F.struct(*rest), "page_idx").alias("p"))
    return best.select("title", "p.*")


def last_by_title(pages: DataFrame) -> DataFrame:
    rest = [c for c in pages.columns if c != "title"]
    best = pages.groupBy("title").agg(F.max_by(F.struct(*rest), "page_idx").alias("p"))
    return best.select("title", "p.*")


def title_changes(local: DataFrame, remote: DataFrame, limit: int = 20) -> DataFrame:
    """change ('new' or 'removed'), title: the first titles of each kind, compared by their keys."""
    keyed = lambda df: df.select("title", T.title_key(F.col("title")).alias("key"))
    new = keyed(remote).join(keyed(local).select("key"), "key", "left_anti").select(F.lit("new").alias("change"), "title")
    gone = keyed(local).join(keyed(remote).select("key"), "key", "left_anti").select(F.lit("removed").alias("change"), "title")
    return new.distinct().orderBy("title").limit(limit).union(gone.distinct().orderBy("title").limit(limit))


def has_changed(local: DataFrame, remote: DataFrame, local_modified: str | None, remote_modified: str | None) -> bool:
    """Whether titles came or went, or the site's last change differs."""
    return local_modified != remote_modified or not title_changes(local, remote, 1).isEmpty()


def stale(fetched: DataFrame, processed: DataFrame) -> DataFrame:
    """One row ``stale``, from one-row tables with a timestamp ``at``: no time known, or fetched later than processed."""
    both = fetched.agg(F.max("at").alias("fetched")).crossJoin(processed.agg(F.max("at").alias("processed")))
    return both.select("fetched", "processed", F.coalesce(F.col("fetched") > F.col("processed"), F.lit(True)).alias("stale"))


def related_edges(tags: DataFrame) -> DataFrame:
    """title, related, pos: the graph of related keys."""
    return tags.select("title", F.posexplode("related").alias("pos", "related"))
