"""Packing by power-of-two decomposition.

A document's ids, closed by the end id, are cut into pieces of ``longest`` and then of the powers
of two that its remainder is the sum of, longest first.  Each piece is a sequence of its own in
the bucket of its length, so no sequence crosses documents and none needs padding.  Batches are
drawn from one bucket at a time.

Defined results
    null text counts as the empty text, whose only id is the end id; repeated rows are packed
    each on its own; an empty table gives an empty result; columns other than the id and the text
    are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import table, text_or_empty
from lodestrata.llm.bpe import ODD, PATTERN, Encoder
from lodestrata.llm.bpe_codec import _vocabulary, default_vocabulary, ship

LONGEST = 1024
END_ID = 0
#: A bucket's sequence numbers begin at its exponent times two to this power; below it stand
#: Spark's partition (25 bits) and the row in it (33 bits).
BUCKET_BITS = 58


@functools.lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    """An encoder that leaves merges to the tiktoken library; its ranks are the vocabulary's ids."""
    import tiktoken

    vocabulary = _vocabulary(name)
    library = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=vocabulary.id_of, special_tokens={})

    def merge(raw: bytes) -> list[int]:
        word = raw.decode()
        return vocabulary.merge(raw) if ODD.search(word) else library.encode_ordinary(word)

    return Encoder(vocabulary, merge=merge)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of ``n`` ids: ``longest`` as often as it fits, then the remainder's powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    longest: int = LONGEST,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids``
    (binary: little-endian unsigned 32-bit) unless they are not asked for."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")
    name = ship(docs.sparkSession, vocabulary or default_vocabulary())
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name).encode
        for batch in batches:
            parts, starts, sizes, sums, totals, ids = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = encode(text) + end
                n, at = len(raw) // 4, 0
                cut = lengths(n, longest)
                for size in cut:
                    piece = raw[4 * at : 4 * (at + size)]
                    sums.append(zlib.crc32(piece))
                    starts.append(at)
                    if with_ids:
                        ids.append(piece)
                    at += size
                parts.append(len(cut))
                sizes += cut
                totals.append(n)
            of = np.repeat(np.arange(len(parts)), parts)
            columns = [batch.column(0).take(pa.array(of)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(sums, pa.int64()), pa.array(np.array(totals, np.int64)[of])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    cut = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias(text_col)).mapInArrow(run, schema)
    bucket = F.log2(F.col("length")).cast("long")
    return cut.withColumns(
        {
            "sequence_id": F.shiftleft(bucket, BUCKET_BITS) + F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences into one folder per length."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
