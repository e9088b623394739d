"""One document of each group of near duplicates: what SimHash links and what the n-gram join links, taken together.

SimHash links texts whose fingerprints lie within a few bits, whatever they differ in; the join links all texts that share
enough of their word shingles, many of which lie further apart than any reach of fingerprints would find.  A group is
connected by links of either kind.  Rows are told apart by a number of their own, so ids may repeat or be missing.

Defined results
    of a group the row with the least id stays, of rows with that id one, and a row without an id only if no other has one;
    null text counts as the empty text, and texts without words are one group; repeated rows are one group; an
    empty table gives an empty result; columns other than the id and the text pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import free_name, settled
from lodestrata.llm.components import components
from lodestrata.llm.ngram_join import ngram_components
from lodestrata.llm.simhash_dedup import simhash_groups


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, reach: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group."""
    row = free_name(docs, "row_number")
    numbered = settled(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    near = simhash_groups(numbered, words, reach, id_col=row, text_col=text_col).select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    alike = ngram_components(numbered, words, percent, row, text_col).select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    roots = components(near.unionByName(alike).where("u <> v"))
    named = numbered.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("id")).join(roots.hint("merge"), "node", "left")
    order = F.struct(F.col("id").isNull(), "id", "node")
    stays = named.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(order).alias("x")).select(F.col("x.node").alias(row))
    return numbered.join(stays, row, "left_semi").select(*docs.columns)
