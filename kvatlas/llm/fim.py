"""Fill-in-the-middle by counted quantifiers.

A text is a row of units: runs of ASCII letters, and single other code points. ``regexp_count`` counts them; two
places are drawn from 0 to that number; and a pattern made for the row, with possessive groups of as many units as
the prefix and the middle have, takes prefix, middle and suffix in one match, which the replacement puts in order:

* plain: the text as it is;
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Possessive groups never go back, and the JVM runs them in a loop and not by recursion, so texts may have any length.
What is drawn depends on seed and id alone: the first four 8-digit groups of the hex SHA-256 of ``seed:id``.
Texts that hold a mark stay plain. Marks can't overlap one another, so no mark arises where pieces meet, and
splitting an output at its marks gives the pieces back. Built-in functions throughout, and no shuffle.

Results for odd input: null text counts as empty, and is plain with no units; a null id is drawn for as if it were an
empty one; repeated rows get the same result; long texts are cut whole; an empty table gives an empty result. Extra columns are left out,
so names can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.shared import table

#: A unit, as a possessive group: the letters of a run stay together.
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
MARKS, SEED, PLAIN_SHARE, SPM_SHARE = ("<P>", "<S>", "<M>"), "1", 10, 20


def drawn(id_col: str, seed: str) -> list[Column]:
    """Four numbers of 32 bits for each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _checked(marks: tuple[str, str, str]) -> None:
    """Refuse marks that could arise where pieces and marks meet."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            # how much of a's end is b's beginning; a mark always ends with all of itself
            ends = range(1, min(len(a), len(b)) + (i != j))
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in ends):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def _literal(mark: str) -> str:
    """A mark as part of a replacement."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, seed: str = SEED,
             plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n, form, output; shares are percentages: of all texts, and of those that aren't plain."""
    _checked(marks)
    p, s, m = map(_literal, marks)
    places = [f"h{k}" for k in range(1, 5)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[h.alias(c) for c, h in zip(places, drawn(id_col, seed), strict=True)])
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= 100 - plain_share)
    for mark in marks:
        plain |= F.contains("text", F.lit(mark))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    counted = lambda n: F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.least(a, b)), counted(F.abs(a - b)), F.lit(r"(.*)\z"))
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    return rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))


def pieces(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """prefix, middle and suffix of an output, as a struct of texts; null if it is plain."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    spm = form == "spm"
    return F.when(form != "plain", F.struct(F.when(spm, parts[2]).otherwise(parts[1]).alias("prefix"), parts[3].alias("middle"), F.when(spm, parts[1]).otherwise(parts[2]).alias("suffix")))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    own = pieces(output, form, marks)
    return F.when(form == "plain", output).otherwise(F.concat(own["prefix"], own["middle"], own["suffix"]))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infilled(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", "n", "form", "output", pieces(F.col("output"), F.col("form")).alias("own"), restored(F.col("output"), F.col("form")).alias("text"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("own.prefix").cast("long").alias("prefix_chars"),
        F.length("own.middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u,
         sha256('1:' || coalesce(doc_id::varchar, '')) h
  from documents),
drawn as (
  select doc_id, t, u, len(u) n, ('0x' || h[1:8])::bigint % (len(u) + 1) x, ('0x' || h[9:16])::bigint % (len(u) + 1) y,
         ('0x' || h[17:24])::bigint % 100 h3, ('0x' || h[25:32])::bigint % 100 h4
  from d),
cut as (
  select doc_id, t, n,
         array_to_string(u[1:least(x, y)], '') p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') m, array_to_string(u[greatest(x, y) + 1:], '') s,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end form
  from drawn)
select doc_id, n, form,
       case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
       sha256(t) restored_sha256
from cut
"""
