"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Words are counted over all documents by native expressions; those at or above the smallest count
that at most ``lexicon_words`` words reach are compiled, with their exact ids, into a transducer
whose suffixes are shared.  Spark ships the file to every executor, which maps it into memory.
Words that the lexicon lacks are merged exactly.  The lexicon decides how fast a word is found,
never its ids.

Defined results
    null text counts as the empty text, which has no ids; ids with nulls stay null; repeated rows
    are encoded each on its own; an empty table gives an empty result and an empty lexicon;
    columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled, table, text_or_empty
from lodestrata.llm.bpe import Encoder, Vocabulary, ids_of, lexicon_file
from lodestrata.llm.lexicon import Lexicon

LEXICON_WORDS = 65_536
WORD_BYTES = 24


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(SparkFiles.get(name))


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    return Encoder(_vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)))


def ship(spark: SparkSession, path: str) -> str:
    """Have Spark copy a local file of the driver to each executor; the name to ask for there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def frequent_words(docs: DataFrame, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, as they stand after a space; at most ``lexicon_words``."""
    word = F.explode(F.split(F.col(text_col), " ")).alias("word")
    counts = settled(
        docs.select(word).where(F.octet_length("word").between(1, WORD_BYTES)).groupBy("word").count().where("count > 3"),
        "words",
    )
    reached, least = 0, None
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count")).limit(lexicon_words).collect():
        if reached + row["words"] > lexicon_words:
            break
        reached, least = reached + row["words"], row["count"]
    if least is None:
        return []
    return [row["word"] for row in counts.where(F.col("count") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> str:
    """Count, compile and ship the lexicon of ``docs``; its name on the executors."""
    spark = docs.sparkSession
    words = [f" {w}" for w in frequent_words(docs, text_col, lexicon_words)]
    blob = lexicon_file(Vocabulary(vocabulary), words)
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), f"{uuid.uuid4().hex}.lexicon")
    with open(path, "wb") as file:
        file.write(blob)
    return ship(spark, path)


def map_encoded(
    docs: DataFrame,
    of: Callable[[Vocabulary, bytes], tuple],
    fields: str,
    vocabulary: str,
    lexicon: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id of each document, and what ``of`` makes of the vocabulary and its ids (little-endian
    unsigned 32-bit) beside them in the worker."""
    name = ship(docs.sparkSession, vocabulary)
    schema = f"{id_col} long, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, lexicon)
        for batch in batches:
            made = [of(encoder.vocabulary, encoder.encode(t)) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array(c) for c in zip(*made, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = [f.split()[0] for f in schema.split(",")]
    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias(text_col)).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, lexicon: str | None = None, **columns: str) -> DataFrame:
    """The id and ``ids`` (binary: little-endian unsigned 32-bit token ids) of each document."""
    vocabulary = vocabulary or default_vocabulary()
    lexicon = lexicon or build_lexicon(docs, vocabulary, columns.get("text_col", "text"))
    return map_encoded(docs, lambda _, ids: (ids,), "ids binary", vocabulary, lexicon, **columns)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``text`` of each row of token ids, special tokens included."""
    name = ship(encoded.sparkSession, vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(name)
        for batch in batches:
            texts = [None if raw is None else known.decode(ids_of(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(run, f"{id_col} long, text string")


@functools.cache
def _decimals(size: int) -> list[str]:
    return [str(n) for n in range(size)]


def _digests(vocabulary: Vocabulary, raw: bytes) -> tuple[int, str, str]:
    ids = ids_of(raw)
    spelled = ",".join(map(_decimals(len(vocabulary.bytes_of)).__getitem__, ids))
    text = vocabulary.decode(ids)
    return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), default_vocabulary()
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_encoded(docs, _digests, fields, vocabulary, build_lexicon(docs, vocabulary))
