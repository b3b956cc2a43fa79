"""A corpus of configurations: statistics, contexts, co-occurrence, filters, differences and duplicates.

Most operators take the exploded form: config_id, tag, value (one row for each key of each configuration).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvatlas.functions import values
from kvatlas.sources.files import kept

#: Keys that make up a context, and keys that are always generated.
CONTEXT_KEYS = ("ENCUT", "PREC", "ISMEAR", "SIGMA", "ISPIN", "GGA", "IBRION", "NSW", "EDIFF", "LREAL", "ALGO", "LORBIT", "ISIF")
ALWAYS_GENERATED = ("ENMAX", "ENMIN", "EXX")


def exploded(configs: DataFrame) -> DataFrame:
    """CONFIG_KV from config_id and ``config_json``, a JSON object; keys keep their order in it.

    A repeated key is one, at its first place and with its last value.
    """
    rows = configs.select("config_id", F.map_entries(F.from_json("config_json", "map<string,variant>")).alias("e"))
    rows = rows.withColumn("keys", F.transform("e", lambda x: x["key"]))
    entry = lambda pos, x: F.struct(pos.cast("int").alias("pos"), x["key"].alias("tag"), x["value"].alias("value"))
    last = lambda x, i: i == F.size("keys") - F.array_position(F.reverse("keys"), x["key"])
    single = F.transform(F.filter("e", last), lambda x: entry(F.array_position("keys", x["key"]) - 1, x))
    own = F.when(F.size(F.array_distinct("keys")) == F.size("keys"), F.transform("e", lambda x, i: entry(i, x))).otherwise(single)
    return rows.select("config_id", F.inline(own)).withColumn("value_json", values.canonical(F.col("value")))


def top(counts: DataFrame, by: str | list[str], order: list[Column], k: int | None) -> DataFrame:
    """The first k rows of each group, with ``rn`` from 1; all of them without k (0 or None)."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = counts.withColumn("rn", F.row_number().over(w))
    return rows.where(F.col("rn") <= k) if k else rows


def tag_stats(kv: DataFrame, configs: DataFrame | None = None, k: int | None = 5) -> DataFrame:
    """tag, cnt, total_configs, freq (percent), rn, value, c: the k commonest values of each tag, or all (k is 0 or None).

    ``configs`` has all configurations, those without keys too; without it, those of ``kv`` count.
    """
    total = configs.agg(F.count(F.lit(1)).alias("total_configs")) if configs is not None else kv.agg(F.countDistinct("config_id").alias("total_configs"))
    return stats_of_counts(kv.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("c")), total, k)


def stats_of_counts(counts: DataFrame, total: DataFrame, k: int | None = 5) -> DataFrame:
    """``tag_stats`` from tag, value, c and one row ``total_configs``."""
    of_tag = counts.groupBy("tag").agg(F.sum("c").alias("cnt"))  # from the counts: no second pass over the rows
    return (
        top(counts, "tag", [F.desc("c"), F.asc("value")], k)
        .join(of_tag, "tag")
        .crossJoin(F.broadcast(total))  # one row
        .select("tag", "cnt", "total_configs", F.round(F.col("cnt") * 100.0 / F.col("total_configs"), 1).alias("freq"), "rn", "value", "c")
    )


def nested_stats(stats: DataFrame) -> DataFrame:
    """TAG_STATS from ``tag_stats``."""
    best = F.transform(F.sort_array(F.collect_list(F.struct("rn", "value", F.col("c").alias("count")))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
    return stats.groupBy("tag", F.col("cnt").alias("count"), "total_configs", F.col("freq").alias("frequency")).agg(best.alias("top_values"))


def contexts(kv: DataFrame, keys: tuple[str, ...] = CONTEXT_KEYS, k: int = 5) -> DataFrame:
    """tag, total, rn, context (sorted ``key=value``, comma-joined), n: typical surroundings of each tag."""
    return contexts_of_counts(context_counts(kv, keys), k)


def context_counts(kv: DataFrame, keys: tuple[str, ...] = CONTEXT_KEYS) -> DataFrame:
    """tag, context, n."""
    own = F.sort_array(F.collect_list(F.when(F.col("tag").isin(*keys), F.concat_ws("=", "tag", "value"))))
    per_config = kv.groupBy("config_id").agg(F.array_join(own, ",").alias("context"), F.collect_list("tag").alias("tags"))
    return per_config.select(F.explode("tags").alias("tag"), "context").groupBy("tag", "context").agg(F.count(F.lit(1)).alias("n"))


def contexts_of_counts(counts: DataFrame, k: int = 5) -> DataFrame:
    totals = counts.groupBy("tag").agg(F.sum("n").alias("total"))
    return top(counts, "tag", [F.desc("n"), F.asc("context")], k).join(totals, "tag").select("tag", "total", "rn", "context", "n")


def cooccurrence(kv: DataFrame) -> DataFrame:
    """a, b, n for each two different tags of one configuration, in both orders.

    A configuration's tags meet in one row, so nothing is joined; each unordered pair is counted once, and counts are mirrored.
    """
    tags = kv.where("config_id is not null").groupBy("config_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    half = tags.select("tags", F.posexplode("tags").alias("pos", "a"))
    half = half.select("a", F.explode(F.slice("tags", F.col("pos") + 2, F.greatest(F.size("tags"), F.lit(1)))).alias("b"))
    half = half.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(both.alias("p"), "n").select("p.a", "p.b", "n")


def partners(pairs: DataFrame, k: int = 5) -> DataFrame:
    return top(pairs, "a", [F.desc("n"), F.asc("b")], k)


def cooccurrence_pair(kv: DataFrame, a: str, b: str) -> DataFrame:
    """One row: configurations in all, with a, with b, with both, and percentages."""
    per_config = kv.groupBy("config_id").agg(*[F.max((F.col("tag") == t).cast("int")).alias(n) for t, n in ((a, "a"), (b, "b"))])
    share = lambda n: F.when(F.col("total") > 0, F.round(F.col(n) * 100.0 / F.col("total"), 1)).otherwise(0.0).alias(f"{n}_percent")
    sums = per_config.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("a", "count_a"), ("b", "count_b"))],
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"),
    )
    return sums.select("*", share("count_a"), share("count_b"), share("both"))


def pair_answer(kv: DataFrame, a: str, b: str, related: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row: ``cooccurrence_pair``, ``wiki_related``, and top_a_values, top_b_values, top_pairs (value, count).

    ``related`` has title, related (an array); either key may name the other.
    """
    counts = kv.where(F.col("tag").isin(a, b)).groupBy("tag", "value").agg(F.count(F.lit(1)).alias("c"))
    listed = lambda order, value, n: F.transform(F.sort_array(F.collect_list(F.struct(order, value, n))), lambda x: F.struct(x[value].alias("value"), x[n].alias("count")))
    best = top(counts, "tag", [F.desc("c"), F.asc("value")], k).groupBy("tag").agg(listed("rn", "value", "c").alias("best"))
    values_ = best.agg(*[F.coalesce(F.max(F.when(F.col("tag") == t, F.col("best"))), F.array()).alias(n) for t, n in ((a, "top_a_values"), (b, "top_b_values"))])
    pairs = value_pairs(kv, a, b, k).select((-F.col("n")).alias("less"), F.concat_ws("=", "value_a", "value_b").alias("pair"), "n")
    pairs = pairs.agg(F.coalesce(listed("less", "pair", "n"), F.array()).alias("top_pairs"))
    edge = F.lit(False).alias("wiki_related")
    known = kv.limit(0).agg(edge)
    if related is not None:
        names = lambda x, y: (F.col("title") == x) & F.array_contains("related", F.lit(y))
        known = related.agg(F.coalesce(F.max(names(a, b) | names(b, a)), F.lit(False)).alias("wiki_related"))
    out = cooccurrence_pair(kv, a, b)
    for one in (known, values_, pairs):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def preview(matches: DataFrame, order: str, most: int = 100, few: int = 3) -> DataFrame:
    """``matches`` with ``note``: all of them if they are ``most`` at the most, else the first ``few`` (the feature here)."""
    total = matches.agg(F.count(F.lit(1)).alias("_total"))
    first = matches.orderBy(order).limit(most).withColumn("_rn", F.row_number().over(Window.orderBy(order)))
    rows = first.crossJoin(F.broadcast(total)).where((F.col("_total") <= most) | (F.col("_rn") <= few))
    note = F.when(F.col("_total") > most, F.concat(F.lit(f"Showing {few} of "), F.col("_total").cast("string"), F.lit(" matches.")))
    return rows.withColumn("note", note).drop("_total", "_rn")


def value_pairs(kv: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """The commonest pairs of values of two tags in one configuration."""
    own = kv.where(F.col("tag").isin(a, b)).groupBy("config_id").agg(*[F.min(F.when(F.col("tag") == t, F.col("value"))).alias(n) for t, n in ((a, "value_a"), (b, "value_b"))])
    counts = own.where("value_a is not null and value_b is not null").groupBy("value_a", "value_b").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value_a", "value_b").limit(k)


def matching(configs: DataFrame, conditions: dict[str, str], any_match: bool = False, config: str = "config") -> DataFrame:
    """Configurations (a variant column) that meet all, or any, of ``key = literal``; a missing key never does."""
    if not conditions:
        return configs
    tests = [values.equals(values.at_key(F.col(config), key), values.filter_literal(s)) for key, s in conditions.items()]
    return configs.where(reduce((lambda x, y: x | y) if any_match else (lambda x, y: x & y), tests))


def by_example(configs: DataFrame, pairs: list[tuple[str, str]], match_all: bool = True, config: str = "config") -> DataFrame:
    """Like ``matching``, but lists hold the numbers that they contain, and each pair of the list counts."""
    if not pairs:
        return configs
    hits = sum((values.member(values.at_key(F.col(config), key), values.example_literal(s)).cast("int") for key, s in pairs), F.lit(0))
    return configs.where(hits == len(pairs) if match_all else hits > 0)


def parameter_values(kv: DataFrame, configs: DataFrame) -> DataFrame:
    """tag, value, n, absent: how often each value occurs; a row with ``absent`` counts configurations without the tag.

    The absent count has a flag of its own, so a real value "nan" can't be taken for it.
    """
    total = configs.agg(F.count(F.lit(1)).alias("total"))
    counts = kv.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("absent", F.lit(False))
    present = kv.select("tag", "config_id").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("p"))
    absent = present.crossJoin(F.broadcast(total)).select("tag", F.lit("nan").alias("value"), (F.col("total") - F.col("p")).alias("n"), F.lit(True).alias("absent"))
    return counts.unionByName(absent.where("n > 0"))


def example_config(analysis: DataFrame, min_frequency: int = 1) -> DataFrame:
    """tag, value, occurrences, commented, alternatives: a configuration of modal values.

    A tag that is mostly absent is commented out with its best real value.
    """
    order = Window.partitionBy("tag").orderBy(F.desc("n"), F.asc("absent"), F.asc("value"))
    kept = ~F.col("absent") & ((F.col("n") >= min_frequency) | (F.col("rv") == 1))  # rare values aren't collected
    real = F.sort_array(F.collect_list(F.when(kept, F.struct((-F.col("n")).alias("less"), "value"))))
    first = Window.partitionBy("tag").orderBy(F.asc("absent"), F.desc("n"), F.asc("value"))
    ranked = analysis.withColumn("rn", F.row_number().over(order)).withColumn("rv", F.row_number().over(first))
    rows = ranked.groupBy("tag").agg(
        F.sum("n").alias("occurrences"), F.max(F.when(F.col("rn") == 1, F.col("absent"))).alias("commented"), real.alias("real")
    )
    rows = rows.where((F.col("occurrences") >= min_frequency) & (F.size("real") > 0))
    others = F.slice("real", 2, F.size("real"))
    return rows.select(
        "tag",
        F.col("real")[0]["value"].alias("value"),
        "occurrences",
        "commented",
        F.array_join(F.transform(others, lambda x: F.concat(x["value"], F.lit(" ("), (-x["less"]).cast("string"), F.lit("x)"))), ", ").alias("alternatives"),
    )


def _key(df: DataFrame, value: str = "value") -> Column:
    """What values of ``df`` are compared by: variants by typed equality (1 = 1.0 = true), other columns as they are."""
    return values.typed(F.col(value)) if dict(df.dtypes)[value] == "variant" else F.col(value)


def difference(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("tag",)) -> DataFrame:
    """``on``, value_1, value_2, state ('common', 'only_1', 'only_2', 'different') of two configurations' rows.

    ``on`` may have columns that tell pairs of configurations apart, so many are compared at once.
    """
    one = left.select(*on, F.col("value").alias("value_1"), _key(left).alias("_1"), F.lit(True).alias("_in_1"))
    two = right.select(*on, F.col("value").alias("value_2"), _key(right).alias("_2"), F.lit(True).alias("_in_2"))
    state = F.when(F.col("_in_2").isNull(), "only_1").when(F.col("_in_1").isNull(), "only_2").when(F.col("_1").eqNullSafe(F.col("_2")), "common")
    return one.join(two, list(on), "full").select(*on, "value_1", "value_2", state.otherwise("different").alias("state"))


def deduplicated(kv: DataFrame) -> DataFrame:
    """config_id, first_id, copies: configurations with the same keys and equal values, whatever their order.

    Grouping compares the whole sorted configuration, keys and values apart; ids travel back by its digest.
    """
    own = F.to_json(F.sort_array(F.collect_list(F.struct("tag", "key"))))
    per_config = kv.select("config_id", "tag", F.coalesce(_key(kv), F.lit("null")).alias("key")).groupBy("config_id").agg(own.alias("body"))
    per_config = per_config.withColumn("digest", F.sha2("body", 256))
    groups = per_config.groupBy("digest", "body").agg(F.min("config_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    rows, groups = kept(per_config.select("config_id", "digest"), "digests"), kept(groups.drop("body"), "groups")
    return looked_up(rows, groups, "digest", "copies").select("config_id", "first_id", "copies")


def looked_up(rows: DataFrame, found: DataFrame, key: str, weight: str, hot: int = 1000) -> DataFrame:
    """``rows`` with their row of ``found`` (one a key), whose ``weight`` says how many rows have the key.

    Keys of more than one in ``hot`` of all rows come by a broadcast, of ``hot`` rows at most, so none of them is one task's.
    """
    most = max((found.agg(F.sum(weight)).head()[0] or 0) // hot, 1000)
    heavy = found.where(F.col(weight) > most)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(found.where(F.col(weight) <= most), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def missing_tags(kv: DataFrame, known: DataFrame, skipped: DataFrame | None = None, min_count: int = 50, identifiers_only: bool = True,
                 always: tuple[str, ...] = ALWAYS_GENERATED, k: int = 3, configs: DataFrame | None = None) -> DataFrame:
    """title, n, value, description, auto_generated: entries for tags of the corpus that ``known`` (title) lacks.

    The enforced ones come whatever their count, once each; the rest needs ``min_count`` configurations.
    ``identifiers_only`` leaves out skipped titles that aren't identifiers. ``configs`` has all configurations, those without
    keys too; without it, those of ``kv`` count.
    """
    spark = kv.sparkSession
    enforced = spark.createDataFrame([(t,) for t in always], "title string")
    if skipped is not None:
        enforced = enforced.union(skipped.select("title").where(F.col("title").rlike(r"^[A-Z][A-Z0-9_]*$") | F.lit(not identifiers_only)))
    enforced = enforced.distinct().join(known.select("title"), "title", "left_anti")
    total = configs.agg(F.count(F.lit(1)).alias("total")) if configs is not None else kv.agg(F.countDistinct("config_id").alias("total"))
    lacking = kv.select(F.col("tag").alias("title"), "value").join(known.select("title"), "title", "left_anti")
    counts = lacking.groupBy("title", "value").agg(F.count(F.lit(1)).alias("c"))
    best = top(counts, "title", [F.desc("c"), F.asc("value")], k).groupBy("title").agg(F.sort_array(F.collect_list(F.struct("rn", "value", "c"))).alias("best"))
    sums = counts.groupBy("title").agg(F.sum("c").alias("n"))
    rows = enforced.withColumn("enforced", F.lit(True)).join(sums.join(best, "title"), "title", "full").crossJoin(F.broadcast(total))
    rows = rows.where(F.coalesce("enforced", F.lit(False)) | (F.col("n") >= min_count))
    listed = F.array_join(F.transform("best", lambda x: F.concat(x["value"], F.lit(" ("), x["c"].cast("string"), F.lit("x)"))), ", ")
    count = F.coalesce("n", F.lit(0)).cast("long")
    share = F.round(count * 100.0 / F.col("total"), 1).cast("string")
    where = F.when(F.coalesce("enforced", F.lit(False)), F.concat(count.cast("string"), F.lit(" configurations"))).otherwise(
        F.concat(count.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" configurations ("), share, F.lit("%)"))
    )
    return rows.select(
        "title",
        count.alias("n"),
        F.coalesce(F.array_join(F.transform("best", lambda x: x["value"]), " | "), F.lit("")).alias("value"),
        F.concat("title", F.lit(" is an input parameter. Appears in "), where, F.lit(". Common values: "), F.coalesce(listed, F.lit("(not in dataset)")), F.lit(".")).alias("description"),
        F.lit(True).alias("auto_generated"),
    )


def appended(index: DataFrame, generated: DataFrame) -> DataFrame:
    """An index of keys (title) with the generated entries behind it; columns that one side lacks are null."""
    new = generated.join(index.select("title"), "title", "left_anti")
    return index.unionByName(new, allowMissingColumns=True)


def not_allowed(kv: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose tag has allowed values (tag, allowed array) and whose value equals none of them."""
    if dict(kv.dtypes)["value"] != "variant":
        return kv.join(allowed, "tag").where(~F.array_contains("allowed", F.col("value")))
    keys = allowed.select("tag", "allowed", F.explode_outer("allowed").alias("one")).select("tag", F.struct("allowed").alias("own"), values.typed(F.col("one")).alias("key"))
    keys = keys.groupBy("tag").agg(F.first("own").alias("own"), F.collect_set("key").alias("keys"))
    rows = kv.join(keys, "tag").withColumn("key", values.typed(F.col("value"))).where(~F.array_contains("keys", F.col("key")))
    return rows.select(*kv.columns, F.col("own.allowed").alias("allowed"))


def required_but_absent(kv: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tags of ``allowed`` that no row of ``kv`` has."""
    return allowed.select("tag").join(kv.select("tag").distinct(), "tag", "left_anti")


def list_values(kv: DataFrame) -> DataFrame:
    """config_id, tag, value with lists taken apart: their elements, or the numbers in a list of lists.

    A list of lists (one that begins with a list) without numbers stands as its JSON text, once. ``kv`` has variants in
    ``value``.
    """
    many = "array<variant>"
    rows = kv.select("config_id", "tag", "value", F.try_variant_get("value", "$", many).alias("items"))
    nested = F.try_variant_get(F.get("items", F.lit(0)), "$", many).isNotNull()
    leaves = F.flatten(F.transform("items", lambda x: F.coalesce(F.try_variant_get(x, "$", many), F.array(x))))
    rows = rows.withColumn("numbers", F.when(nested, F.filter(leaves, lambda x: values.kind(x) == "number")))
    own = F.when(F.size("numbers") > 0, F.col("numbers")).when(F.col("numbers").isNotNull() | F.col("items").isNull(), F.array("value")).otherwise(F.col("items"))
    return rows.select("config_id", "tag", F.explode(own).alias("value")).withColumn("value", values.canonical(F.col("value")))


def analysis_summary(analysis: DataFrame) -> DataFrame:
    """One row: parameters, those with several values, and those that are mostly absent."""
    per = analysis.groupBy("tag").agg(
        F.sum((~F.col("absent")).cast("int")).alias("different"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("absent"), F.col("n"))), F.lit(0)).alias("missing"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("parameters"),
        F.coalesce(F.sum((F.col("different") > 1).cast("long")), F.lit(0)).alias("several_values"),
        F.coalesce(F.sum((F.col("missing") * 2 > F.col("n")).cast("long")), F.lit(0)).alias("mostly_absent"),
    )


def example_lines(example: DataFrame, width: int = 12) -> DataFrame:
    """tag, commented, occurrences, line: the text of an example configuration, in the order of ``example_text`` once sorted so."""
    tail = F.when(F.col("alternatives") != "", F.concat(F.lit("  # "), "alternatives")).otherwise("")
    head = F.when(F.col("commented"), "# ").otherwise("")
    return example.select("tag", "commented", "occurrences", F.concat(head, F.rpad("tag", width, " "), F.lit(" = "), "value", tail).alias("line"))


def example_text(lines: DataFrame) -> DataFrame:
    """number, line of an example configuration's text: lines by falling occurrences, then an empty line and the commented ones.

    ``lines`` is what ``example_lines`` gives, one row a key; ties go by key.
    """
    order = Window.orderBy("commented", F.desc("occurrences"), "tag")
    rows = lines.withColumn("number", F.row_number().over(order))
    plain = lines.agg(F.sum((~F.col("commented")).cast("int")).alias("plain"), F.sum(F.col("commented").cast("int")).alias("others"))
    rows = rows.crossJoin(F.broadcast(plain)).select((F.col("number") + F.col("commented").cast("int")).alias("number"), "line")
    return rows.unionByName(plain.where("others > 0").select((F.col("plain") + 1).cast("int").alias("number"), F.lit("").alias("line")))


def write_example(lines: DataFrame, path: str) -> None:
    """The text as one file, in order."""
    example_text(lines).coalesce(1).sortWithinPartitions("number").select("line").write.mode("overwrite").text(path)
