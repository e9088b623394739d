"""A stored index for substring search over sections.

Four tables below one folder: ``sections`` in ranges of pages; ``postings`` (term, page, ordinal,
host, in_path) in ranges of terms; ``terms``, each once; ``hosts`` with the number of sections and
characters of each.  A term is a lower-cased run of letters, digits and plus signs.  A query token
of such characters stands in a text just if it stands in one of its terms, so a search reads the
terms, then the postings of those that hold a token, then the sections of the pages found.  Both
are sorted, so that few terms or pages are met by skipping the row groups of all others; many are
met by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APART = r"[^\p{L}\p{N}+]+"
#: Up to so many terms or pages are named in a filter; more are joined.
NAMED = 20_000


def _terms(column: str):  # noqa: ANN202
    return F.explode(F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(column, F.lit(""))), APART)), "")).alias("term")


def build_index(sections: DataFrame, path: str) -> None:
    """Write the index of ``sections`` (page, ordinal, host, path, text and others) below ``path``."""
    spark = sections.sparkSession
    sections.repartitionByRange("page").sortWithinPartitions("page", "ordinal").write.mode("overwrite").parquet(f"{path}/sections")
    stored = spark.read.parquet(f"{path}/sections")
    # A path is the same for all sections of a page, so its terms are posted once, without an ordinal.
    in_text = stored.select("page", "ordinal", "host", F.lit(False).alias("in_path"), _terms("text"))
    paths = stored.select("page", "host", "path").distinct()
    in_path = paths.select("page", F.lit(None).cast("int").alias("ordinal"), "host", F.lit(True).alias("in_path"), _terms("path"))
    postings = in_text.withColumn("ordinal", F.col("ordinal").cast("int")).unionByName(in_path)
    postings.repartitionByRange("term", "page").sortWithinPartitions("term", "page").write.mode("overwrite").parquet(f"{path}/postings")
    stored_postings = spark.read.parquet(f"{path}/postings")
    stored_postings.select("term").distinct().write.mode("overwrite").parquet(f"{path}/terms")
    hosts = stored.groupBy("host").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.char_length("text")).alias("chars"))
    hosts.write.mode("overwrite").parquet(f"{path}/hosts")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    read = spark.read.parquet
    return SearchIndex(read(f"{path}/sections"), read(f"{path}/postings"), read(f"{path}/terms"), read(f"{path}/hosts"))


@dataclass
class SearchIndex:
    sections: DataFrame
    postings: DataFrame
    terms: DataFrame
    hosts: DataFrame
    host: str | None = None
    asked: tuple[set[str], DataFrame] | None = field(default=None, repr=False)

    def on(self, host: str | None) -> SearchIndex:
        """The same index, narrowed to a host."""
        return self if host == self.host else replace(self, host=host, asked=None)

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows if self.host is None else rows.where(F.col("host") == self.host)

    def totals(self) -> tuple[int, float]:
        """How many sections there are and their mean length."""
        row = self._own(self.hosts).agg(F.sum("sections").alias("n"), F.sum("chars").alias("chars")).first()
        return row["n"] or 0, (row["chars"] or 0) / max(1, row["n"] or 0)

    def posted(self, forms: list[str]) -> DataFrame:
        """form, page, ordinal and in_path, each once, of postings under terms that hold one of the forms.

        The postings of one question stay cached for its next steps, until another is asked.
        """
        wanted = {f.lower() for f in forms}
        if self.asked is None or not wanted <= self.asked[0]:
            held = F.explode(F.filter(F.array(*map(F.lit, sorted(wanted))), lambda f: F.contains("term", f))).alias("form")
            met = self.terms.select("term", held)
            few = met.limit(NAMED + 1).collect()
            rows = self._own(self.postings)
            if len(few) <= NAMED:
                rows = rows.where(F.col("term").isin(sorted({r["term"] for r in few})))
                met = self.sections.sparkSession.createDataFrame(few, met.schema)
            if self.asked is not None:
                self.asked[1].unpersist()
            self.asked = wanted, rows.join(met, "term").select("form", "page", "ordinal", "in_path").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        return self.asked[1].where(F.col("form").isin(sorted(wanted)))

    def frequencies(self, tokens: list[str]) -> dict[str, int]:
        """In how many sections' texts each token stands."""
        rows = self.posted(tokens).where("not in_path").groupBy("form").count().collect()
        found = {r["form"]: r["count"] for r in rows}
        return {t: found.get(t.lower(), 0) for t in tokens}

    def holding(self, forms: list[str], in_path: bool = True) -> DataFrame:
        """The sections that hold one of the forms, case aside, in their text or, unless told otherwise, their path."""
        met = self.posted(forms) if in_path else self.posted(forms).where("not in_path")
        # A posting of a path has no ordinal and stands for all sections of its page.
        places = met.groupBy("page").agg(F.collect_set("ordinal").alias("places"), F.bool_or("in_path").alias("whole"))
        few = places.limit(NAMED + 1).collect()
        rows = self._own(self.sections)
        if len(few) <= NAMED:
            rows = rows.where(F.col("page").isin([r["page"] for r in few]))
            places = self.sections.sparkSession.createDataFrame(few, places.schema)
        held = rows.join(places, "page").where(F.col("whole") | F.array_contains("places", F.col("ordinal").cast("int")))
        return held.drop("places", "whole")
