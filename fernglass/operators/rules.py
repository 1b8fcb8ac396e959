"""Reader's rules (J6, Q22, Q29, F11): substring rules, global or for one feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fernglass.functions.texts import contains_text

#: Global rules of one automaton: what a task holds. More rules are more passes, each over its own rules.
RULES_A_PASS = 100_000


def _matching_global(items: DataFrame, patterns: list[str], key: str, text: str) -> DataFrame:
    """Items that hold any pattern; each text in lower case once through an automaton of all patterns, in Arrow batches."""
    shared = items.sparkSession.sparkContext.broadcast(sorted({p.lower() for p in patterns}))  # at most RULES_A_PASS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holds = _any_of(shared.value)
        for b in batches:
            yield b.loc[[holds(t) for t in b["t"].str.lower()], [key]]

    kind = items.schema[key].dataType.simpleString()
    return items.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}")


def _any_of(patterns: list[str]) -> Callable[[str], bool]:
    if "" in patterns:
        return lambda t: True
    if not patterns:
        return lambda t: False
    try:
        import ahocorasick
    except ImportError:
        return lambda t: any(p in t for p in patterns)
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, True)
    automaton.make_automaton()
    return lambda t: next(automaton.iter(t), None) is not None


def blocked(items: DataFrame, rules: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Q22: (key) of the items that a blocking rule matches. ``fields``: the text of each dimension; rules with a null
    feed_id are global, others meet their feed's items by an equi join. An empty pattern matches every text."""
    out = None
    on = rules.where("blocks and pattern is not null")
    glob = on.where("feed_id is null").select("dimension", "pattern").distinct()
    sizes = {r[0]: r[1] for r in glob.groupBy("dimension").count().collect()}  # a row for each dimension
    for dimension, text in fields.items():
        found = items.select(key).limit(0)
        passes = -(-sizes.get(dimension, 0) // RULES_A_PASS)
        for k in range(passes):
            some = glob.where((F.col("dimension") == dimension) & (F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)).select("pattern").toPandas()["pattern"].tolist()
            found = found.unionByName(_matching_global(items, some, key, text))
        local = on.where((F.col("dimension") == dimension) & F.col("feed_id").isNotNull()).select("feed_id", "pattern").distinct()
        own = items.join(local, "feed_id").where(contains_text(F.col(text), F.col("pattern"))).select(key)
        both = found.unionByName(own)
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def seeded(feeds: DataFrame, hosts: list[str], dimension: str, pattern: str) -> DataFrame:
    """Q29: a rule for every feed whose address holds one of the hosts."""
    hit = F.lit(False)
    for h in hosts:
        hit = hit | F.col("url").contains(h)
    return feeds.where(hit).select(F.lit(dimension).alias("dimension"), F.lit(pattern).alias("pattern"), F.lit(True).alias("blocks"), "feed_id", F.lit("seed").alias("source"))
