"""Three-valued decisions: is a service offered, and which kind of answer follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.facts import latest_set

UNSPECIFIED = "unspecified"


def serves(asked: DataFrame, hours: DataFrame, coverage: DataFrame) -> DataFrame:
    """Whether each asked (facility, day, meal, term) is served: true, false or null for unknown.

    hours: facility, valid_from, weekday (0 Sunday), meal ('' for any), term, closed.
    coverage: facility, complete (whether what is not listed is closed).
    The latest observation up to the day counts.  Rows without a term decide only where the term
    has none of its own, and a yes from them alone is unknown.  Without a term asked, terms must
    agree on no.
    """
    past = asked.join(hours, "facility").where(F.col("valid_from") <= F.col("day"))
    last = past.groupBy("facility", "day", "meal_asked", "term_asked").agg(F.max("valid_from").alias("valid_from"))
    keys = ["facility", "day", "meal_asked", "term_asked"]
    keyed = asked.withColumn("_t", F.coalesce("term_asked", F.lit("")))
    last = last.withColumn("_t", F.coalesce("term_asked", F.lit(""))).drop("term_asked")
    rows = keyed.join(last, ["facility", "day", "meal_asked", "_t"]).join(hours, ["facility", "valid_from"])
    rows = rows.where(F.col("weekday") == F.dayofweek("day") - 1)
    on_term = F.col("meal").isin("") | (F.col("meal") == F.col("meal_asked"))
    concrete = F.col("term") != UNSPECIFIED
    per_term = rows.groupBy("facility", "day", "meal_asked", "_t", "term").agg(
        F.count_if(on_term).alias("deciding"), F.coalesce(F.bool_or(on_term & F.col("closed")), F.lit(False)).alias("any_closed")
    )
    verdict = F.when(F.col("deciding") == 0, F.lit(None).cast("boolean")).otherwise(~F.col("any_closed"))
    per_term = per_term.withColumn("verdict", verdict)
    own = F.col("term") == F.col("_t")
    loose = ~concrete
    g = per_term.groupBy("facility", "day", "meal_asked", "_t").agg(
        F.coalesce(F.bool_or(own), F.lit(False)).alias("has_own"),
        F.max(F.when(own, F.col("verdict"))).alias("own_verdict"),
        F.coalesce(F.bool_or(loose), F.lit(False)).alias("has_loose"),
        F.max(F.when(loose, F.col("verdict"))).alias("loose_verdict"),
        F.coalesce(F.bool_and(loose), F.lit(False)).alias("only_loose"),
        F.count_if(concrete).alias("concrete"),
        F.count_if(concrete & (F.col("verdict") == F.lit(True))).alias("yes"),
        F.count_if(concrete & F.col("verdict").isNull()).alias("unknown"),
    )
    known = asked.select(*keys).withColumn("_t", F.coalesce("term_asked", F.lit("")))
    seen = last.select("facility", "day", "meal_asked", "_t").withColumn("observed", F.lit(True))
    on = ["facility", "day", "meal_asked", "_t"]
    out = known.join(seen, on, "left").join(g, on, "left").join(coverage, "facility", "left")
    absent = F.when(F.coalesce("complete", F.lit(False)), F.lit(False))
    demoted = F.when(F.col("loose_verdict"), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("loose_verdict"), absent))
    loose_out = F.when(F.col("loose_verdict").isNull(), absent).otherwise(demoted)
    with_term = F.when(F.col("has_own"), F.coalesce("own_verdict", absent)).when(F.col("has_loose"), loose_out).otherwise(absent)
    unknown_no = F.coalesce("complete", F.lit(False))
    agreed_no = (F.col("yes") == 0) & ((F.col("unknown") == 0) | unknown_no)
    without = F.when(F.col("only_loose"), loose_out).when((F.col("concrete") > 0) & agreed_no, F.lit(False))
    decided = F.when(F.col("observed").isNull(), F.lit(None).cast("boolean")).when(F.col("has_own").isNull(), absent).when(F.col("_t") != "", with_term).otherwise(without)
    return out.select("facility", "day", "meal_asked", "term_asked", decided.alias("serves"))


def branch(found: Column, stale: Column, operating_with_items: Column, all_closed: Column, served: Column) -> Column:
    """A: the menu; B: not offered; C-1: offered but not known; C-2: not known."""
    by_serves = F.when(served.isNull(), "C-2").when(served, "C-1").otherwise("B")
    return F.when(found & stale, "C-2").when(~found, by_serves).when(operating_with_items, "A").when(all_closed, "B").otherwise(by_serves)


def answer_verdict(expected: Column, found: Column, has_needed: Column) -> Column:
    """right, deferred, wrong or rightly_deferred."""
    return (
        F.when((expected == "defer") & ~found, "rightly_deferred")
        .when((expected == "defer") & found, "wrong")
        .when(~found, "deferred")
        .when(has_needed, "right")
        .otherwise("wrong")
    )


def bottleneck(in_title: Column, in_text: Column, anywhere: Column) -> Column:
    """Where a missed answer is lost: it could be found, stands in bodies only, or isn't covered."""
    return F.when(in_title, "search").when(in_text, "body_only").when(anywhere, "body_only").otherwise("coverage")


def manual_state(text: Column, valid_to: Column, today: Column) -> Column:
    """State of an answer entered by hand."""
    return F.when(text.isNull() | (F.trim(text) == ""), "empty").when(valid_to.isNull(), "no_expiry").when(valid_to < today, "expired").otherwise("ready")


__all__ = ["answer_verdict", "bottleneck", "branch", "latest_set", "manual_state", "serves"]
