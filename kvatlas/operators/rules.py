"""Features derived from a configuration, and edits that make a configuration have given features.

A configuration is a map from key to JSON text. Features are boolean, but for ``spin`` and ``nelect``, which are
JSON text: a boolean, or a number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("soc", "nosym", "hyperfine", "pbe", "pbesol", "scan", "hse0", "pbe0", "phonon", "relax2", "relax3")
FEATURES = (*FLAGS, "spin", "nelect")


#: Keys that the features are derived from.
READ = ("LSORBIT", "ISYM", "LHYPERFINE", "GGA", "METAGGA", "LHFCALC", "HFSCREEN", "IBRION", "ISIF", "ISPIN", "NUPDOWN", "NELECT")


def featured(df: DataFrame, config: str = "config") -> DataFrame:
    """``df`` with a column ``_f_<name>`` for each feature.

    Values are taken from the map once, into columns of their own, which go again.
    """
    keyed = df.select("*", *[F.try_element_at(config, F.lit(k)).alias(f"_k_{k}") for k in READ])
    return keyed.select("*", *[c.alias(f"_f_{n}") for n, c in features(lambda key: F.col(f"_k_{key}")).items()]).drop(*[f"_k_{k}" for k in READ])


def features(value: Callable[[str], Column]) -> dict[str, Column]:
    """Each feature as a column; ``value`` gives a key's JSON text."""
    number = lambda key: F.when(value(key) == "true", 1.0).when(value(key) == "false", 0.0).otherwise(value(key).try_cast("double"))
    holds = lambda test: F.coalesce(test, F.lit(False))
    quoted = lambda key, s: holds(value(key) == f'"{s}"')
    relaxes = holds(number("IBRION").isin(1.0, 2.0, 3.0))
    exchange = holds(value("LHFCALC") == "true")
    screened = holds(number("HFSCREEN") > 0)
    return {
        "soc": holds(value("LSORBIT") == "true"),
        "nosym": holds(number("ISYM").isin(0.0, -1.0)),
        "hyperfine": holds(value("LHYPERFINE") == "true"),
        "pbe": quoted("GGA", "PE"),
        "pbesol": quoted("GGA", "PS"),
        "scan": holds(F.contains(value("METAGGA"), F.lit("SCAN"))),
        "hse0": exchange & screened,
        "pbe0": exchange & (value("HFSCREEN").isNull() | holds(number("HFSCREEN") == 0)),
        "phonon": holds(number("IBRION").isin(5.0, 6.0, 7.0, 8.0)),
        "relax2": relaxes & (value("ISIF").isNull() | holds(number("ISIF") == 2)),
        "relax3": relaxes & holds(number("ISIF") == 3),
        "spin": F.when(value("ISPIN").isNull(), "false").when(value("NUPDOWN").isNotNull(), value("NUPDOWN")).otherwise(holds(number("ISPIN") == 2).cast("string")),
        "nelect": value("NELECT"),
    }


def active(df: DataFrame, config: str = "config") -> DataFrame:
    """``df`` with ``features``: names of those that differ from their defaults; numbers follow ``spin`` and ``nelect``."""
    f = {n: F.col(f"_f_{n}") for n in FEATURES}
    spin = F.when(f["spin"] == "true", "spin").when(f["spin"] != "false", F.concat(F.lit("spin="), f["spin"]))
    named = [F.when(f[n], n) for n in FLAGS] + [spin, F.when(f["nelect"].isNotNull(), F.concat(F.lit("nelect="), f["nelect"]))]
    return featured(df, config).withColumn("features", F.array_compact(F.array(*named))).drop(*[f"_f_{n}" for n in FEATURES])


def edited(df: DataFrame, wanted: dict[str, bool | int | float], config: str = "config") -> DataFrame:
    """``df`` with ``edited``: the configuration with the wanted features; unknown ones are ignored, others stay.

    Rules apply in order, later ones winning, and a key that no feature claims is taken out: GGA, LHFCALC, and
    IBRION with NSW. Whether a key is set, and to what, are columns of their own.
    """
    rows = featured(df, config)
    now = {n: F.col(f"_f_{n}") for n in FEATURES}
    new = now | {n: F.lit(json.dumps(wanted[n])) if n in ("spin", "nelect") else F.lit(bool(wanted[n])) for n in wanted if n in FEATURES}
    changed = {n: ~new[n].eqNullSafe(now[n]) for n in FEATURES}
    isset: dict[str, Column] = {}
    to: dict[str, Column] = {}

    def put(when: Column, **keys) -> None:
        for key, text in keys.items():
            value = (text if isinstance(text, Column) else F.lit(text)).cast("string")
            isset[key] = isset[key] | when if key in isset else when
            to[key] = F.when(when, value).otherwise(to[key]) if key in to else F.when(when, value)

    put(changed["soc"], LSORBIT=new["soc"].cast("string"))
    put(changed["nosym"], ISYM=F.when(new["nosym"], "-1"))
    put(changed["hyperfine"], LHYPERFINE=new["hyperfine"].cast("string"))
    put(new["pbe"] & changed["pbe"], GGA='"PE"')
    put(new["pbesol"] & changed["pbesol"], GGA='"PS"')
    put(~new["pbe"] & ~new["pbesol"], GGA=None)
    put(changed["scan"], METAGGA=F.when(new["scan"], '"r2SCAN"'))
    put(new["hse0"] & changed["hse0"], LHFCALC="true", HFSCREEN="0.2", ALGO='"All"', PRECFOCK='"Fast"')
    put(new["pbe0"] & changed["pbe0"], LHFCALC="true", HFSCREEN=None, ALGO='"All"', PRECFOCK='"Fast"')
    put(~new["hse0"] & ~new["pbe0"], LHFCALC=None)
    polarised = new["spin"] == "true"
    counted = ~new["spin"].isin("true", "false")
    put(changed["spin"] & (polarised | counted), ISPIN="2", NUPDOWN=F.when(counted, new["spin"]))
    put(changed["spin"] & ~polarised & ~counted, ISPIN=None, NUPDOWN=None)
    put(changed["nelect"], NELECT=new["nelect"])
    put(new["phonon"] & changed["phonon"], IBRION="6", NSW="1", ISIF="3")
    put(new["relax2"] & changed["relax2"], IBRION="2", ISIF="2", NSW="25")
    put(new["relax3"] & changed["relax3"], IBRION="2", ISIF="3", NSW="25")
    put(~new["phonon"] & ~new["relax2"] & ~new["relax3"], IBRION=None, NSW=None)

    rows = rows.select("*", *[c.alias(f"_set_{k}") for k, c in isset.items()], *[c.alias(f"_to_{k}") for k, c in to.items()])
    touched = F.array_compact(F.array(*[F.when(F.col(f"_set_{k}"), k) for k in isset]))
    kept = F.filter(F.map_entries(config), lambda e: ~F.array_contains(touched, e["key"]))
    put_in = F.array_compact(F.array(*[F.when(F.col(f"_set_{k}") & F.col(f"_to_{k}").isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"_to_{k}").alias("value"))) for k in isset]))
    added = [f"_f_{n}" for n in FEATURES] + [f"_{x}_{k}" for k in isset for x in ("set", "to")]
    return rows.withColumn("edited", F.map_from_entries(F.concat(kept, put_in))).drop(*added)


def changes(before: Column, after: Column) -> Column:
    """(key, old, new) of what an edit changed; removed keys have a null ``new``."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(before, k).alias("old"), F.try_element_at(after, k).alias("new")))
    return F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
