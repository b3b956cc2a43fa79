"""Names to entries: tiered resolution, fuzzy matching, and the combined answer for a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvatlas.functions import text as T
from kvatlas.sources.files import kept

#: Abbreviations of keys; a user's table takes precedence.
ALIASES = {
    "soc": "LSORBIT",
    "dft+u": "LDAU",
    "dft": "GGA",
    "gga": "GGA",
    "pbe": "GGA",
    "hse": "HFSCREEN",
    "gw": "ALGO",
    "vdw": "IVDW",
    "bse": "ALGO",
    "phonon": "IBRION",
    "hubbard": "LDAU",
    "hubbard u": "LDAU",
    "molecular dynamics": "IBRION",
}
#: Names of up to so many characters are looked up as wholes; more names than that aren't sent to every task.
WHOLE, MOST_SENT = 16, 100_000
EXACT, ALIAS, FILE, FUZZY, SUBSTRING = "exact", "term_map", "file_page", "fuzzy", "substring"


def overlaid_aliases(built_in: DataFrame, user: DataFrame) -> DataFrame:
    """alias, target of both tables; the user's wins."""
    keyed = user.select(F.lower(T.strip(F.col("alias"))).alias("alias"), F.col("target").alias("own"))
    return built_in.join(keyed, "alias", "full").select("alias", F.coalesce("own", "target").alias("target"))


def resolve(names: DataFrame, index: DataFrame, aliases: DataFrame, files: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
    """name, stage, title: for each of ``names`` the entries of ``index`` (title) of the first stage that has any.

    Stages: exact (upper case), alias, page about a file, close matches, and titles that contain the name.
    """
    keyed = names.select("name", F.upper(T.strip(F.col("name"))).alias("up"), F.lower(T.strip(F.col("name"))).alias("low")).distinct()
    titles = index.select("title").distinct()
    found = keyed.join(titles, F.col("up") == F.col("title")).select("name", F.lit(1).alias("rank"), F.lit(EXACT).alias("stage"), "title")
    by_alias = keyed.join(aliases, F.col("low") == F.col("alias")).join(titles, F.col("target") == F.col("title"))
    found = found.union(by_alias.select("name", F.lit(2), F.lit(ALIAS), "title"))
    if files is not None:
        page = keyed.join(files.select("title").distinct(), F.col("up") == F.col("title"))
        found = found.union(page.select("name", F.lit(3), F.lit(FILE), "title"))
    # only names without a match go on to the stages that compare with every title
    open_ = keyed.join(found.select("name"), "name", "left_anti")
    if fuzzy:
        close = close_titles(open_.select("name"), titles)
        found = found.union(close.select("name", F.lit(4), F.lit(FUZZY), "title"))
    part = containing(open_.select("name", "up"), titles)
    found = found.union(part.select("name", F.lit(5), F.lit(SUBSTRING), "title"))
    least = found.groupBy("name").agg(F.min("rank").alias("rank"))
    return found.join(least, ["name", "rank"]).select("name", "stage", "title").distinct()


def _grams(s: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters."""
    starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(n))))


def containing(names: DataFrame, titles: DataFrame) -> DataFrame:
    """name, title: the titles that contain a name's ``up``, which isn't empty.

    Titles are cut into their runs of the names' lengths, and a name meets the runs that equal it, so no title is searched in vain.
    A name of more than ``WHOLE`` characters meets the titles that have the rarest of its runs of ``WHOLE`` characters, and only
    these are searched for it. Names are written first: with few of them, titles' runs needn't move.
    """
    names = kept(names.where("up <> ''").select("name", "up").distinct(), "names")
    titles = titles.where("title is not null").select("title")
    sizes = names.groupBy(F.least(F.length("up"), F.lit(WHOLE + 1)).alias("size")).count().collect()  # WHOLE + 1 rows at most
    if sum(r["count"] for r in sizes) > MOST_SENT:
        names = names.hint("merge")
    runs = lambda *n: titles.select("title", F.explode(F.flatten(F.array(*[_grams(F.col("title"), i) for i in n]))).alias("gram"))
    found = names.select("name").crossJoin(titles).where(F.lit(False))
    if whole := sorted(r["size"] for r in sizes if r["size"] <= WHOLE):
        found = found.union(runs(*whole).join(names, F.col("gram") == F.col("up")).select("name", "title"))
    if len(whole) < len(sizes):
        own = names.where(F.length("up") > WHOLE).select("name", "up", F.explode(_grams(F.col("up"), WHOLE)).alias("gram"))
        of_titles = runs(WHOLE).join(own.select("gram").distinct(), "gram", "left_semi")  # only runs that some name has
        frequent = of_titles.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = own.join(frequent, "gram", "left").groupBy("name", "up").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
        rarest = rarest.where("m.n > 0").select("name", "up", F.col("m.gram").alias("gram"))  # a run that no title has: no match
        found = found.union(rarest.join(of_titles, "gram").where(F.contains("title", F.col("up"))).select("name", "title"))
    return found


def _length_class(n: Column) -> Column:
    """Lengths that differ by less than half share a class."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)) + 0.0) * 2).cast("int")


def _bounds(own: list[str], others: list[str]) -> np.ndarray:
    """For each pair, an upper bound of the ratio: twice the letters in common, by how often they occur, over both lengths."""
    place = {c: i for i, c in enumerate(sorted(set("".join(own))))}
    counts = [np.zeros((len(x), len(place)), np.int32) for x in (own, others)]
    for matrix, texts in zip(counts, (own, others), strict=True):
        letters = [[place[c] for c in t if c in place] for t in texts]
        np.add.at(matrix, (np.repeat(np.arange(len(texts)), [len(x) for x in letters]), [c for x in letters for c in x]), 1)
    size = np.array([len(t) for t in others])
    out = np.empty((len(own), len(others)))
    for i, row in enumerate(counts[0]):
        at = np.flatnonzero(row)
        both = len(own[i]) + size
        out[i] = np.where(both > 0, 2.0 * np.minimum(counts[1][:, at], row[at]).sum(1) / np.maximum(both, 1), 1.0)
    return out


def matched_blocks(names: DataFrame, titles: DataFrame, k: int, cutoff: float, block: int, titles_block: int) -> DataFrame:
    """name, title, ratio of each block's k best, and for each name and block a row without title that counts ``verified`` titles.

    A ratio of ``cutoff`` needs lengths and letters in common: titles are kept by classes of lengths, and a name meets the
    classes that its length allows. There, all titles are bounded by counts of letters at once, and matched in descending order of the bound
    until it is below the k-th best match.
    """
    asked = names.select("name").where("name is not null").distinct().withColumn("size", F.length(F.upper(T.strip(F.col("name")))))
    known = titles.select("title").where("title is not null").distinct().withColumn("size", F.length("title"))
    known = known.withColumn("class", F.when(F.col("size") == 0, -1).otherwise(_length_class(F.col("size"))))
    sizes = known.groupBy("class").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).collect()  # a row a class: under 70
    if not sizes:
        return names.sparkSession.createDataFrame([], "name string, title string, ratio double, verified long")
    classes = names.sparkSession.createDataFrame([(r["class"], r["least"], r["most"], -(-r["n"] // titles_block)) for r in sizes], "class int, least int, most int, parts int")
    n = max(1, -(-asked.count() // block))
    low, high = F.col("size") * (cutoff / (2 - cutoff)) - 1e-9, F.col("size") * ((2 - cutoff) / cutoff) + 1e-9
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), parts).cast("int")
    left = asked.join(F.broadcast(classes), (F.col("most") >= low) & (F.col("least") <= high))
    left = left.select("name", dealt("name", F.lit(n)).alias("i"), "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    right = known.join(F.broadcast(classes.select("class", "parts")), "class").select("title", "class", dealt("title", F.col("parts")).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))

    def best(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out, candidates, keys = [], others["title"].tolist(), [name.strip().upper() for name in own["name"]]
        if not keys or not candidates:
            return pd.DataFrame(columns=["name", "title", "ratio", "verified"])
        bounds = _bounds(keys, candidates)
        for name, key, bound in zip(own["name"], keys, bounds, strict=True):
            matcher, found, verified = SequenceMatcher(), [], 0
            matcher.set_seq2(key)
            at = np.flatnonzero(bound >= cutoff)
            for i in at[np.argsort(-bound[at], kind="stable")].tolist():
                if len(found) == k and bound[i] < found[-1][0]:
                    break
                matcher.set_seq1(candidates[i])
                verified += 1
                if (r := matcher.ratio()) >= cutoff:
                    found = sorted([*found, (r, candidates[i])], reverse=True)[:k]
            out += [(name, t, r, None) for r, t in found] + [(name, None, None, verified)]
        return pd.DataFrame(out, columns=["name", "title", "ratio", "verified"]).astype({"verified": "Int64"})

    key = ["class", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "name string, title string, ratio double, verified long")


def close_titles(names: DataFrame, titles: DataFrame, k: int = 3, cutoff: float = 0.5, block: int = 256, titles_block: int = 20_000) -> DataFrame:
    """name, title, ratio: the k closest titles by Ratcliff-Obershelp matching, ties to the greater title.

    ``names`` is a table of questions; see ``matched_blocks``. The rest is a window over each block's k best.
    """
    from kvatlas.operators.configs import top

    pairs = matched_blocks(names, titles, k, cutoff, block, titles_block).where("title is not null").drop("verified")
    return top(pairs, "name", [F.desc("ratio"), F.desc("title")], k).drop("rn")


def close_work(names: DataFrame, titles: DataFrame, k: int = 3, cutoff: float = 0.5, block: int = 256, titles_block: int = 20_000) -> DataFrame:
    """One row: names, titles, pairs of them, and how many pairs ``close_titles`` matches in full (verified)."""
    sums = matched_blocks(names, titles, k, cutoff, block, titles_block).agg(F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    count = lambda df, c: df.agg(F.countDistinct(c).alias(f"{c}s"))
    both = count(names, "name").crossJoin(F.broadcast(count(titles, "title"))).crossJoin(F.broadcast(sums))  # one row each
    return both.select("names", "titles", (F.col("names") * F.col("titles")).alias("pairs"), "verified")


def entry_or_hint(names: DataFrame, index: DataFrame, upper: bool = True) -> DataFrame:
    """name, outcome ('entry', 'several', 'missing'), titles: what a lookup by name answers.

    The title that equals the name, else the only one that contains it, is the entry; several are suggestions in
    order. With ``upper``, names are keys in capitals; without, they are page titles: equal as they are written, or
    contained in any case, and even a single containing page is a hint ('several').
    """
    given = names.where("name is not null").select("name").distinct()
    titles = index.select("title").distinct()
    key = F.upper("name") if upper else F.col("name")
    exact = given.join(titles.withColumn("_key", F.upper("title") if upper else F.col("title")), key == F.col("_key")).groupBy("name").agg(F.min("title").alias("title"))
    rest = given.join(exact.select("name"), "name", "left_anti")
    folded = titles.select(F.col("title").alias("shown"), (F.col("title") if upper else F.lower("title")).alias("title"))
    folded = F.col("title") if upper else F.lower("title")
    part = containing(rest.select("name", (F.upper("name") if upper else F.lower("name")).alias("up")), titles.select(folded.alias("title")).distinct())
    if not upper:
        part = part.withColumnRenamed("title", "_low").join(titles, F.col("_low") == folded)
    part = part.groupBy("name").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    rows = given.join(exact, "name", "left").join(part, "name", "left")  # each name once, so what is found for it is computed once
    lone = (F.size("titles") == 1) & F.lit(upper)
    outcome = F.when(F.col("title").isNotNull() | lone, "entry").when(F.col("titles").isNotNull(), "several").otherwise("missing")
    own = F.when(F.col("title").isNotNull(), F.array("title")).otherwise(F.coalesce("titles", F.array().cast("array<string>")))
    return rows.select("name", outcome.alias("outcome"), own.alias("titles"))


def related_of(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, outcome, titles, related: the related keys of each name's entry (``tags``: title, related), null unless there is one.

    Tags are written first, as parsing their pages takes longer than looking names up in them.
    """
    own = kept(tags.groupBy("title").agg(F.min("related").alias("related")), "tags")
    found = entry_or_hint(names, own)
    only = F.when(F.col("outcome") == "entry", F.get("titles", F.lit(0)))
    return found.withColumn("_only", only).join(own, F.col("_only") == F.col("title"), "left").select("name", "outcome", "titles", "related")


def find(titles: DataFrame, name: str) -> DataFrame:
    """Titles equal to the name in any case, else all that contain it."""
    exact = titles.where(F.lower("title") == name.lower()).select("title", F.lit(0).alias("rank"))
    part = titles.where(F.contains(F.lower("title"), F.lit(name.lower()))).select("title", F.lit(1).alias("rank"))
    both = exact.union(part)
    least = both.agg(F.min("rank").alias("rank"))
    return both.join(F.broadcast(least), "rank").select("title").distinct()


def stats_of(stats: DataFrame, name: str, first_only: bool = True) -> DataFrame:
    """Statistics of the key of this name, else of those that contain it: the first, or all for the caller to refuse."""
    up = name.upper()
    rows = stats.where(F.contains("tag", F.lit(up))).withColumn("rank", (F.col("tag") != up).cast("int"))
    least = rows.agg(F.min(F.struct("rank", "tag")).alias("m")).select(F.col("m.rank").alias("rank"), F.col("m.tag").alias("first"))
    rows = rows.join(F.broadcast(least), "rank")
    return (rows.where(F.col("tag") == F.col("first")) if first_only else rows).drop("rank", "first")


def answer(tags: DataFrame, stats: DataFrame, contexts: DataFrame, partners: DataFrame) -> DataFrame:
    """One row for each tag: its entry, statistics, contexts and commonest partners, nested.

    ``stats`` and ``contexts`` are one row a tag; ``partners`` has a, b, n, rn.
    """
    near = partners.groupBy(F.col("a").alias("title")).agg(F.sort_array(F.collect_list(F.struct("rn", F.col("b").alias("tag"), "n"))).alias("cooccur"))
    return (
        tags.join(stats.withColumnRenamed("tag", "title"), "title", "left")
        .join(contexts.withColumnRenamed("tag", "title"), "title", "left")
        .join(near, "title", "left")
        .withColumn("description_length", F.length("description"))
    )
