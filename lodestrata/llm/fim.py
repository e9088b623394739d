"""Fill-in-middle transformation by a table-driven byte automaton.

One table, indexed by state and byte, holds the next state and what the transition emits: a unit
where a code point begins, a sentinel where the last byte of ``<P>``, ``<S>`` or ``<M>`` is read.
Texts are scanned in blocks, all blocks of a chunk in step; a block begins in the state that its
three bytes before lead to, which is exact because no state depends on more.  The scan counts the
emitted units and sentinels per block.  From these counts the two cuts of a text fall into one block
each, and a second pass over those blocks alone locates the bytes where they lie.

The cuts of a text follow from its id alone, so a lost task makes the same ones again.

Defined results
    null text counts as the empty text; an empty text, or one that contains a sentinel, stays plain; a
    null id draws its numbers from the empty string in place of an id; repeated rows give repeated
    equal rows; an empty table gives an empty result; columns other than the id and the text are
    ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import table, text_or_empty

#: What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: States: between units; one to three bytes of a unit to come; after "<"; after "<" and a sentinel's letter.
START, OPENED, LETTER = 0, 4, 5
STATES = 8
#: Of a table entry, the bits of the state; those of the unit and the sentinel emitted lie above.
STATE_BITS, UNIT, SENTINEL = 3, 1 << 8, 1 << 24
#: Bytes of a block, and of texts scanned together.
BLOCK, CHUNK = 512, 8 << 20


def transitions() -> np.ndarray:
    """The table: entry ``state * 256 + byte``."""
    made = np.zeros((STATES, 256), np.int32)
    for state in range(STATES):
        for byte in range(256):
            if 0x80 <= byte < 0xC0:  # goes on with a unit; a stray one emits nothing
                made[state, byte] = state - 1 if 1 <= state <= 3 else START
                continue
            after = START
            if byte >= 0xC0:
                after = 1 + (byte >= 0xE0) + (byte >= 0xF0)
            elif byte == ord("<"):
                after = OPENED
            elif state == OPENED and byte in b"PSM":
                after = LETTER
            ends = state == LETTER and byte == ord(">")
            made[state, byte] = after + UNIT + (SENTINEL if ends else 0)
    return made.reshape(-1)


TABLE = transitions()


def _states(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state at each block's start; ``first``: those at which a text begins."""
    state = np.zeros(len(starts), np.int32)
    inner = np.nonzero(~first)[0]
    for back in (3, 2, 1):
        state[inner] = TABLE[(state[inner] << 8) | data[starts[inner] - back]] & ((1 << STATE_BITS) - 1)
    return state


def _step(data: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One byte of each block: changes ``state``, returns what was emitted."""
    entry = TABLE[(state << 8) | data[at]]
    np.bitwise_and(entry, (1 << STATE_BITS) - 1, out=state)
    return entry >> 8


class Scan:
    """Counts of the texts ``data[offsets[i]:offsets[i + 1]]`` after the first pass."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        self.data, self.offsets = data, offsets
        self.first_block = np.concatenate(([0], np.cumsum(blocks)))
        own = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(own)) - self.first_block[own]
        self.starts = offsets[own] + place * BLOCK
        self.lengths = np.minimum(offsets[own + 1] - self.starts, BLOCK)
        self.begin = _states(data, self.starts, place == 0)
        order = np.argsort(-self.lengths, kind="stable")
        at, state, emitted = self.starts[order], self.begin[order], np.zeros(len(own), np.int32)
        active = np.searchsorted(-self.lengths[order], -np.arange(1, BLOCK + 1), "right")
        for step in range(BLOCK):
            k = int(active[step])
            if not k:
                break
            emitted[:k] += _step(data, at[:k] + step, state[:k])
        counted = np.empty_like(emitted)
        counted[order] = emitted
        self.units_before = np.concatenate(([0], np.cumsum(counted & 0xFFFF)))
        sentinels = np.concatenate(([0], np.cumsum(counted >> 16)))
        ends = self.first_block
        self.units = self.units_before[ends[1:]] - self.units_before[ends[:-1]]
        self.sentinels = sentinels[ends[1:]] - sentinels[ends[:-1]]

    def places(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The second pass: the byte at which unit ``unit`` of a text begins, or the text's end."""
        at = self.offsets[text + 1].copy()
        inner = np.nonzero(unit < self.units[text])[0]
        wanted = self.units_before[self.first_block[text[inner]]] + unit[inner]
        block = np.searchsorted(self.units_before, wanted, "right") - 1
        left = wanted - self.units_before[block]
        start, state, length = self.starts[block], self.begin[block].copy(), self.lengths[block]
        open_ = np.arange(len(inner))
        for step in range(BLOCK):
            open_ = open_[step < length[open_]]
            if not len(open_):
                break
            now = state[open_]
            emitted = _step(self.data, start[open_] + step, now) & 0xFFFF
            state[open_] = now
            found = (emitted > 0) & (left[open_] == 0)
            at[inner[open_[found]]] = start[open_[found]] + step
            left[open_] -= emitted
            open_ = open_[~found]
        return at


def _transformed(batch: pa.RecordBatch, plain_from: int, spm_below: int) -> pa.RecordBatch:
    texts = batch.column("text")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32 if pa.types.is_string(texts.type) else np.int64, len(texts) + 1, texts.offset * (4 if pa.types.is_string(texts.type) else 8)).astype(np.int64)
    raw = memoryview(data if data is not None else b"")
    scan = Scan(np.frombuffer(raw, np.uint8) if len(raw) else np.zeros(0, np.uint8), offsets)
    h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    n = scan.units
    cuts = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(*cuts), np.maximum(*cuts)
    plain = (n == 0) | (scan.sentinels > 0) | (h[2] % 100 >= plain_from)
    spm = h[3] % 100 < spm_below
    cut = np.nonzero(~plain)[0]
    first, second = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    both = scan.places(np.concatenate((cut, cut)), np.concatenate((low[cut], high[cut])))
    first[cut], second[cut] = both[: len(cut)], both[len(cut) :]
    outputs, forms = [], []
    for a, x, y, b, is_plain, is_spm in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            forms.append("plain")
            outputs.append(bytes(raw[a:b]))
        elif is_spm:
            forms.append("spm")
            outputs.append(b"".join((SUFFIX, raw[y:b], PREFIX, raw[a:x], MIDDLE, raw[x:y])))
        else:
            forms.append("psm")
            outputs.append(b"".join((PREFIX, raw[a:x], SUFFIX, raw[y:b], MIDDLE, raw[x:y])))
    arrays = [batch.column("id"), pa.array(n), pa.array(forms), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(outputs, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (code points), form, prefix_chars, middle_chars and output of each row.

    Of 100 texts about ``plain_from`` are cut, and of these ``spm_below`` put their suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")), np.int64)
            # Chunks of whole texts, of CHUNK bytes or one text.
            at, total = 0, np.concatenate(([0], np.cumsum(sizes)))
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
                yield _transformed(batch.slice(at, end - at), plain_from, spm_below)
                at = end

    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(name, 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}") for i in (1, 2, 3, 4)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *numbers)
    return rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone: a cut text has three sentinels and no other."""
    parts = F.split(output, "<[PSM]>", 4)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
    SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM t
), v AS (
    SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
            WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), w AS (
    SELECT *, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM v
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM w"""
