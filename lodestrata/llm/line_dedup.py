"""Line dedup by an exact set-similarity join, in native expressions only.

A line's tokens are its lower-cased words, each once.  Lines with equal token sets are one entry,
found by an aggregate that combines before it shuffles, so a line that is everywhere costs one row
per map task; before such a line goes, its words are compared with those of the line that stays.
Every entry orders its tokens by rarity.  Two entries of the wanted Jaccard similarity share a
token of their prefixes, where the longer entry's prefix is that of the similarity itself and the
shorter entry's that of the share of tokens it then has in common.  Pairs that meet under a token
must pass the length filter, the positional filter and a bound from 128-bit parity signatures (the
signatures differ in no more bits than the sets do in tokens).  All of these are necessary
conditions, so no pair is lost; what passes is verified on the words themselves.

A line goes if any earlier line matches it, so one earlier match per entry is enough.  The first
step finds most of them: entries with the same neighbouring tokens near the end of their prefixes
are held against the first of them alone, so pairs within a large group of near copies are never
spelled out.  Entries without a match so far are then held against all others under their tokens;
those that have one only stand as the earlier side.

Rarity comes from counts over all documents in 65,536 hash buckets.  Any order of tokens gives the
same result; the counts only keep the lists short.

Defined results
    null texts stay null; lines without words always stay; a line of the empty or a very long text
    is a line like any other; rows come in the order of their ids, a null id first, and lines in
    that of the text; rows that repeat an id stand at one place and don't remove each other's
    lines; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import free_name, settled, table

BUCKETS = 1 << 16
PERCENT = 80
#: So many tokens at the end of a prefix are looked at in the first step; a shorter prefix is drawn out to them.
NEAR = 9
#: The second step takes the tokens in so many parts, one after the other, which bounds its space on disk.
PARTS = 2
#: Bits of a line's place in its text within a number that holds both the text's id and the place.
POS_BITS = 31


# Cuts are exploded as outer, since Spark makes a filter on the size of what is exploded otherwise, and cuts twice.


#: Most joins here have a side with each key once.
stored = functools.partial(settled, by_hash="64m")


def _plain(text: Column) -> Column:
    """A text lower-cased, with spaces as the only white space within lines: what a cut at single spaces needs."""
    return functools.reduce(lambda t, space: F.replace(t, F.lit(space), F.lit(" ")), "\t\r\x0b\x0c", F.lower(text))


def words_of(line: Column) -> Column:
    """The words of a line, lower-cased, repeats included."""
    return F.array_remove(F.split(_plain(line), " "), "")


def _sketch(docs: DataFrame, text_col: str) -> Column:
    """For each bucket of words a small number: how frequent they are, on a log scale."""
    word = F.explode_outer(F.split(F.replace(F.lower(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    ranks = [0] * BUCKETS
    for bucket_no, count in docs.where(F.col(text_col).isNotNull()).select(word).select(bucket).groupBy("bucket").count().collect():  # a row a bucket
        ranks[bucket_no] = min(126, int(4 * math.log2(count)))
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _hashes(line: Column) -> Column:
    """The token set of a line of a plain text as different hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _codes(hashes: Column, sketch: Column) -> Column:
    """The token set as ascending numbers: rarity in the upper byte, a 56-bit hash below it."""

    def code(h: Column) -> Column:
        rank = F.get(sketch, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(hashes, code))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, pos and line, plain, of each line that has words."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.split(_plain(F.col(text_col)), "\n").alias("lines")
    )
    return rows.select("id", "text_key", F.posexplode_outer("lines").alias("pos", "line")).where(F.trim("line") != "")


def _first_id(docs: DataFrame, id_col: str) -> int | None:
    """The smallest id, if no id repeats and the ids lie so close that id and place fit one number; else none."""
    of = F.col(id_col).cast("long")
    met = docs.select(of.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    low, high, most = met.agg(F.min("id"), F.max("id"), F.max("rows")).first()
    if most is None or most > 1:
        return None
    low, high = (0, 0) if low is None else (low, high)
    return low if high - low < (1 << 62 - POS_BITS) else None


def _number(first: int) -> Column:
    """id and pos as one number in their order, a null id first."""
    return F.shiftleft(F.coalesce(F.col("id") - F.lit(first) + 1, F.lit(0).cast("long")), POS_BITS).bitwiseOR(F.col("pos").cast("long"))


def _unnumbered(first: int) -> dict[str, Column]:
    """id and pos of a number made by ``_number``."""
    above, pos = F.shiftright("number", POS_BITS), F.col("number").bitwiseAND(F.lit((1 << POS_BITS) - 1))
    return {"id": F.when(above > 0, above - 1 + F.lit(first)), "pos": pos.cast("int")}


def _place() -> Column:
    """The order of lines as one number, which an aggregate can keep in place: by id, a null id first, then pos."""
    number = F.col("id").cast("decimal(20,0)") * F.lit(1 << 31)
    return (F.coalesce(number, F.lit(str(-(1 << 95))).cast("decimal(31,0)")) + F.col("pos")).cast("decimal(38,0)")


def _apart(a: str, b: str) -> Column:
    """In how many bits two signatures differ: in no more than the sets do in tokens."""
    low, high = (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("sig", "sig2"))
    return low + high


def _passes(percent: int) -> Column:
    """Length, positional and signature filters between postings a and b."""
    n, m, i, j = (F.col(f"{s}.{c}") for c in ("n", "i") for s in ("a", "b"))
    most = F.least(n - i, m - j) + 1
    return (
        (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
        & (most * (100 + percent) >= (n + m) * percent)
        & (_apart("a", "b") * (100 + percent) <= (n + m) * (100 - percent))
    )


def _able(entries: DataFrame, percent: int) -> DataFrame:
    """Without the sets too small to match a different set."""
    return entries.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)


def _posted(entries: DataFrame, length: Column) -> DataFrame:
    """token, and number, n, i (from 1), open and signatures of each entry posted under the first ``length`` of its prefix."""
    rows = entries.select("number", "n", "sig", "sig2", "open", F.posexplode_outer(F.slice("prefix", F.lit(1), length)).alias("i", "token"))
    return rows.withColumn("i", F.col("i") + 1)


def _prefix_length(n: Column, percent: int) -> Column:
    """So many of the rarest tokens hold one that a set of at most the same size and the wanted similarity has."""
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _short_length(n: Column, percent: int) -> Column:
    """The same where the other set has at least the same size."""
    return n - F.floor((n * (2 * percent) + 99 + percent) / (100 + percent)).cast("int") + 1


def _first_of_neighbours(entries: DataFrame) -> DataFrame:
    """(x, y): y is the first of the entries that have three neighbouring tokens in common with x."""
    near = F.slice("prefix", F.greatest(F.size("prefix") - (NEAR - 1), F.lit(1)), F.lit(NEAR))
    token = lambda i: F.get(F.col("near"), i)
    runs = F.transform(F.slice("near", F.lit(1), F.greatest(F.size("near") - 2, F.lit(1))), lambda c, i: F.xxhash64(c, token(i + 1), token(i + 2)))
    keyed = entries.select("number", near.alias("near")).select("number", F.explode_outer(runs).alias("run"))
    first = keyed.groupBy("run").agg(F.min("number").alias("y"), F.max("number").alias("last")).where("y < last").select("run", "y")
    return keyed.join(first, "run").where("number > y").select(F.col("number").alias("x"), "y").distinct()


def _met_under_tokens(entries: DataFrame, matched: DataFrame, percent: int, part: int) -> DataFrame:
    """(x, y, apart): y is earlier than x, x is not among the x of ``matched``, and the two pass the filters under a token of the part."""
    n, open_, able = F.col("n"), F.col("open"), _able(entries, percent)
    long, short = _prefix_length(n, percent), _short_length(n, percent)
    marked = matched.select(F.col("x").alias("number"), F.lit(False).alias("open"))
    able = able.join(marked, "number", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    # Of each pair the later one is open, so a large group that is matched is not held against itself.
    # Of two open ones the longer is a; a matched one is b, be it longer or shorter.
    a, b = _posted(able.where(open_), long).drop("open"), _posted(able, F.when(open_, short).otherwise(long))
    a, b = (side.where(F.pmod("token", F.lit(PARTS)) == part) for side in (a, b))
    in_order = F.when(F.col("b.open"), F.col("a.n") >= F.col("b.n")).otherwise(F.col("a.number") > F.col("b.number"))
    held = a.alias("a").join(b.alias("b"), F.col("a.token") == F.col("b.token"))
    held = held.where(_passes(percent) & in_order & (F.col("a.number") != F.col("b.number")))
    x, y = F.greatest("a.number", "b.number"), F.least("a.number", "b.number")
    return held.select(x.alias("x"), y.alias("y"), _apart("a", "b").alias("apart")).distinct()


def _words(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """number and different words of each of ``wanted`` (number, id, pos, and text_key where ids may repeat), read from the texts."""
    keyed = "text_key" in wanted.columns
    placed = wanted.groupBy(F.col("id").alias("of"), *["text_key"] * keyed).agg(F.collect_set(F.struct("pos", "number")).alias("places"))
    placed = stored(placed, "places")
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("own_key"), F.col(text_col).alias("body")
    )
    own = F.col("id").eqNullSafe(F.col("of"))
    met = rows.join(placed, own & (F.col("own_key") == F.col("text_key")) if keyed else own)
    # The lines are bound to a name in the expression, so that they are cut once a text.
    picked = lambda lines: F.transform("places", lambda p: F.struct(p["number"].alias("number"), F.get(lines, p["pos"]).alias("line")))
    met = met.select(F.inline_outer(F.flatten(F.transform(F.array(F.split("body", "\n")), picked))))
    met = stored(met.select("number", F.array_distinct(words_of(F.col("line"))).alias("words")), "words")
    # A number is there twice only if a row of the table is.
    if not keyed or met.groupBy("number").count().where("count > 1").isEmpty():
        return met
    return stored(met.dropDuplicates(["number"]), "words")


def _numbers(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("number")).distinct()


def _verified(pairs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """x of the pairs (x, y) whose words, found in ``met``, have the wanted Jaccard similarity."""
    both = pairs.join(met.select(F.col("number").alias("x"), F.col("words").alias("left")), "x")
    both = both.join(met.select(F.col("number").alias("y"), F.col("words").alias("right")), "y")
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(shared * 100 >= (F.size("left") + F.size("right") - shared) * percent).select("x").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key and pos of every line that an earlier line matches, and ``words``: for a line whose
    set of tokens hashes like an earlier one, the words it has to have, spaced; null for others."""
    sketch = _sketch(docs, text_col)
    low, high = (_parity(F.col("hashes"), of) for of in (0, 1))
    n = F.size("codes")
    length = _prefix_length(n, percent)
    full = stored(
        _lines(docs, id_col, text_col)
        .select("id", "text_key", "pos", _hashes(F.col("line")).alias("hashes"))
        .select("id", "text_key", "pos", low.alias("sig"), high.alias("sig2"), _codes(F.col("hashes"), sketch).alias("codes"))
        .select(
            "id", "text_key", "pos", n.alias("n"), "sig", "sig2", F.xxhash64("codes").alias("key"),
            F.transform(F.slice("codes", F.lit(1), F.greatest(length, F.lit(NEAR))), lambda c: F.hash(c)).alias("prefix"),
        ),
        "lines",
    )
    same = ["key", "sig", "sig2", "n"]
    # Grouping by what the key stands for keeps the aggregate's state in place.
    first_id, sets, rows = _first_id(docs, id_col), full.groupBy(*same, "prefix"), F.count(F.lit(1)).alias("rows")
    if first_id is not None:
        entries = stored(sets.agg(F.min(_number(first_id)).alias("number"), rows), "entries").withColumns(_unnumbered(first_id))
    else:
        sets = full.withColumn("place", _place()).groupBy(*same, "prefix")
        sets = sets.agg(F.min("place").alias("place"), *(F.min_by(c, "place").alias(c) for c in ("id", "text_key", "pos")), rows)
        # Numbers in the order of first places: a sort by ranges, then counting within them.
        entries = stored(sets.orderBy("place", "key").drop("place").withColumn("number", F.monotonically_increasing_id()), "entries")

    def placed(numbers: DataFrame) -> DataFrame:
        """Where the first lines of the sets of these numbers stand."""
        if first_id is not None:
            return numbers.withColumns(_unnumbered(first_id))
        return entries.select("number", "id", "text_key", "pos").join(numbers, "number", "left_semi")

    near = stored(_first_of_neighbours(_able(entries, percent)), "near")
    # The words of one line of each set that has several, too: they all have to have these.
    places = placed(_numbers(near).unionByName(entries.where("rows > 1").select("number")).distinct())
    spelled = _words(places, docs, id_col, text_col)
    matched = stored(_verified(near, spelled, percent), "matched")
    # Lists may be long, and a merge reads them in order.
    met = [settled(_met_under_tokens(entries, matched, percent, part), "met") for part in range(PARTS)]
    met = stored(functools.reduce(DataFrame.unionByName, met).distinct(), "met")
    spelled_again = _words(placed(_numbers(met)), docs, id_col, text_col)
    # One match is enough, so the nearest by signature is verified before all others.
    more = stored(_verified(met.groupBy("x").agg(F.min_by("y", "apart").alias("y")), spelled_again, percent), "more")
    rest = met.join(more, "x", "left_anti").select("x", "y")
    last = stored(_verified(rest, spelled_again, percent), "last")
    gone = matched.unionByName(more).unionByName(last).select(F.col("x").alias("number"), F.lit(True).alias("goes"))
    judged = entries.select(*same, "number", "rows", F.col("id").alias("first_id"), F.col("pos").alias("first_pos"))
    spelled = spelled.select("number", F.array_join("words", " ").alias("words"))
    judged = judged.join(gone, "number", "left").where("rows > 1 or goes").join(spelled, "number", "left").drop("number", "rows")
    at_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))
    lines = full.select("id", "text_key", "pos", *same).join(judged, same)
    lines = lines.where(F.col("goes").isNotNull() | ~at_first)
    return lines.select("id", "text_key", "pos", F.when(~at_first, F.col("words")).alias("words"))


def _parity(hashes: Column, of: int) -> Column:
    """A signature's half: which of its 64 bits, picked by a hash's upper six bits, are met an odd
    number of times by the tokens whose lowest bit is ``of``."""
    one = F.lit(1).cast("long")
    # Tokens of the other half shift a zero.
    mine = lambda h: h.bitwiseAND(one) if of else F.bitwise_not(h).bitwiseAND(one)
    place = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", mine(h), place(h))))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the lines that an earlier line matches; with ``counts``, the numbers of
    lines and of removed lines in columns of these names."""
    found = removed_lines(docs, percent, id_col, text_col).groupBy("id", "text_key").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))
    own_id, own_key, places, cut = (free_name(docs, c) for c in ("own_id", "own_key", "gone", "cut"))
    found = stored(found.select(F.col("id").alias(own_id), F.col("text_key").alias(own_key), F.col("gone").alias(places)), "gone")
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left")
    joined, lines = joined.withColumn(cut, F.split(text_col, "\n")), F.col(cut)

    def goes(place: Column) -> Column:
        """Whether the words are those that the line has to have, where it has to."""
        own, wanted = F.sort_array(F.array_distinct(words_of(F.get(lines, place["pos"])))), F.split(place["words"], " ")
        return wanted.isNull() | (own == F.sort_array(wanted))

    joined = joined.withColumn(places, F.transform(F.filter(F.col(places), goes), lambda place: place["pos"]))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(places), i)), "\n")
    made = {text_col: F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept)}
    if counts:
        made[counts[0]] = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
        made[counts[1]] = F.coalesce(F.size(places), F.lit(0)).cast("long")
    return joined.withColumns(made).drop(own_id, own_key, places, cut)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed"))


SQL = """
WITH l AS (
    SELECT doc_id, u.pos, u.line FROM documents,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos) u
    WHERE text IS NOT NULL
),
t AS (
    SELECT doc_id, pos, line, list_sort(list_distinct(list_filter(
        string_split_regex(lower(line), '[\\x09\\x0b\\x0c\\x0d ]+'), lambda x: x <> ''))) AS ws FROM l
),
s AS (
    SELECT ws, min({'d': doc_id, 'p': pos}) AS f, len(ws) AS n, row_number() OVER () AS k
    FROM t WHERE len(ws) > 0 GROUP BY ws
),
w AS (SELECT k, n, f, unnest(ws) AS w FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, w) AS i FROM (SELECT w.*, count(*) OVER (PARTITION BY w) AS c FROM w)),
p AS (SELECT * FROM r WHERE i <= n - (n * 4 + 4) // 5 + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.w = b.w AND b.f < a.f AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
m AS (
    SELECT DISTINCT c.a AS k FROM c JOIN s x ON x.k = c.a JOIN s y ON y.k = c.b
    WHERE len(list_intersect(x.ws, y.ws)) * 5 >= (x.n + y.n - len(list_intersect(x.ws, y.ws))) * 4
),
g AS (
    SELECT t.doc_id, t.pos, t.line, coalesce((s.f <> {'d': t.doc_id, 'p': t.pos}) OR m.k IS NOT NULL, false) AS gone
    FROM t LEFT JOIN s ON s.ws = t.ws LEFT JOIN m ON m.k = s.k
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(g.line, chr(10) ORDER BY g.pos) FILTER (WHERE NOT g.gone), '') END AS text,
    count(g.pos) AS n_lines, count(g.pos) FILTER (WHERE g.gone) AS n_removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
