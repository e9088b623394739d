"""Facts with provenance: guarded scans, validity, as-of sets, nested children, ranked joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored

VERIFIED = "verified"
#: What every fact row carries.
PROVENANCE = ("source_id", "source_url", "observed_at", "valid_from", "valid_to", "confidence", "extraction_method", "status", "tier")


def facts(table: DataFrame, where: Column | None = None) -> DataFrame:
    """The verified rows of a fact table; reads see no others."""
    rows = table.where(F.col("status") == VERIFIED)
    return rows if where is None else rows.where(where)


def provenance_ok() -> Column:
    """No part of the provenance is missing, and what was entered by hand expires."""
    needed = [F.col(c).isNotNull() for c in PROVENANCE if c != "valid_to"]
    return reduce(Column.__and__, needed) & ((F.col("tier") != "T4") | F.col("valid_to").isNotNull()) & F.col("confidence").between(0, 1)


def natural_key(*columns: str) -> list[Column]:
    """Key columns with the empty string for null, so that equal keys are equal."""
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]


def valid_on(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))


def overlaps(since: Column, until: Column, start: str, end: str) -> Column:
    """Whether an interval, its end null for a single day, overlaps [since, until]."""
    return (F.col(start) <= until) & (F.coalesce(F.col(end), F.col(start)) >= since)


def open_on(day: Column, deadline: str) -> Column:
    """Rows without a deadline are open."""
    return F.col(deadline).isNull() | (F.col(deadline) >= day)


def optional(value: object | None, column: str) -> Column:
    """Equality with a value if there is one."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def contains_any(columns: list[str], needles: list[str]) -> Column:
    """Whether any column holds any needle, case aside."""
    hits = [F.contains(F.lower(F.col(c)), F.lit(n.lower())) for c in columns for n in needles]
    return reduce(Column.__or__, hits, F.lit(False))


def contains_only(column: str, short: str, longer: list[str]) -> Column:
    """Whether a column holds a name but none of the longer names around it."""
    return F.contains(F.col(column), F.lit(short)) & ~reduce(Column.__or__, [F.contains(F.col(column), F.lit(n)) for n in longer], F.lit(False))


def in_list_field(column: str, wanted: str) -> Column:
    """Whether a comma-separated field has an entry."""
    return F.array_contains(F.transform(F.split(F.col(column), ","), lambda p: F.trim(p)), wanted)


def latest_per(table: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_set(table: DataFrame, keys: list[str], day: Column, stamp: str = "valid_from") -> DataFrame:
    """All rows of each key's latest observation up to a day.

    An aggregate finds the day of each key and combines before it shuffles; a window would sort
    all history.
    """
    past = table.where(F.col(stamp) <= day)
    last = past.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return past.join(last, [*keys, stamp], "left_semi")


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children in the order of the fields; empty if none."""
    nested = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(nested, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def ranked_exact_join(left: DataFrame, right: DataFrame, key: str, rank: Column, order: list[Column], value: str, label: Column) -> DataFrame:
    """Left rows with the right side's first value by rank, and the others' labels as an array.

    Names are joined by equality alone.  Rows without a partner have a null value and no others.
    """
    w = Window.partitionBy(key).orderBy(rank, *order)
    ranked = right.withColumn("_n", F.row_number().over(w)).withColumn("_label", label)
    picked = ranked.groupBy(key).agg(
        F.max(F.when(F.col("_n") == 1, F.col(value))).alias(value),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "_label")))), lambda x: x["_label"]
        ).alias("others"),
    )
    return left.join(picked, key, "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def climb(nodes: DataFrame, key: str, parent: str, limit: int = 8) -> DataFrame:
    """Each node's topmost ancestor within ``limit`` steps, and the steps taken.

    Pointer doubling: each round joins every node with where its pointer's pointer leads, so three
    rounds take eight steps.
    """
    now = nodes.select(F.col(key), F.coalesce(F.col(parent), F.col(key)).alias("top"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("steps"))
    done = 1
    while done < limit:
        up = now.select(F.col(key).alias("_key"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        now = now.join(up, now["top"] == up["_key"], "left").select(
            key, F.coalesce("_top", "top").alias("top"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
        done *= 2
    return now


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """node, ancestor and steps for all ancestors of each node.

    By doubling: what lies within so many steps, and from those at exactly that distance as far again.
    """
    reach = stored(nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps")), "ancestors")
    done = 1
    while not (edge := reach.where(F.col("steps") == done)).isEmpty():
        on = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("steps").alias("_more"))
        further = edge.join(on, "ancestor").select("node", F.col("_next").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        reach = stored(reach.unionByName(further), "ancestors")
        done *= 2
    return reach


def ancestor_overlap(hits: DataFrame, above: DataFrame) -> DataFrame:
    """``hits`` (question, node): per question its hits, those with an ancestor among the hits, and how many such ancestors there are."""
    both = hits.join(above, "node").join(hits.select("question", F.col("node").alias("ancestor")), ["question", "ancestor"])
    met = both.groupBy("question").agg(F.count_distinct("node").alias("covered"), F.count_distinct("ancestor").alias("covering"))
    total = hits.groupBy("question").agg(F.count(F.lit(1)).alias("hits"))
    return total.join(met, "question", "left").fillna(0, ["covered", "covering"])


def siblings(nodes: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Pairs of different nodes under one parent."""
    other = nodes.select(*keys, F.col(key).alias("sibling"))
    return nodes.select(*keys, key).join(other, keys).where(F.col(key) != F.col("sibling"))


def longest_match(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Of each text the longest name it holds.

    The names are a dictionary; each is met as a run of the text's words, so the join is by
    equality and no pair of text and name is formed in vain.
    """
    low = names.withColumn("_low", F.lower(F.trim(name)))
    longest = low.agg(F.max(F.size(F.split("_low", r"\s+")))).first()[0] or 1
    words = F.split(F.lower(F.col(text)), r"\s+")

    def runs_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    met = texts.select(key, words.alias("_w")).select(key, F.explode(F.array_distinct(F.concat(*runs))).alias("_low"))
    hits = met.join(low, "_low")
    w = Window.partitionBy(key).orderBy(F.desc(F.char_length(name)), name)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_low")
