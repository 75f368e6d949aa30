"""Line deduplication up to a few edits, by segment partitions.

Two lines within t edits share one of t + 1 segments: a line of length l is cut
into t + 1 nearly equal segments, and if another line holds none of them at a
near enough place, each segment took an edit of its own. So every line is
indexed by its segments, and probes the index for its own length and up to t
characters less, with those substrings only whose places differ from the
segment's by no more than the edits before it and after it can shift. Keys are
hashes of (segment number, length, substring). Pairs that share a key are
confirmed by exact banded edit distance.

1. Occurrences become distinct lines first, with their first place and number,
   however often a line occurs. Equality is that of two 64-bit hashes together.
2. Keys are made once, from the distinct lines; what no other line shares is
   left in the task that meets the key. Keys that a fixed share of the lines
   holds several times over are found beforehand and dealt over all tasks; that
   share steers where rows go, never what comes out.
3. A key that over ``HOT_KEY`` lines hold is split by the segments of what is
   left of the lines, which must be as near to each other as the lines are.
4. Each line is compared with the earliest line of its keys; only lines that
   this does not settle are compared with all others of a key.
5. Occurrences are told what was found by a join on the line; the commonest
   lines, at most ``HOT_LINES``, are broadcast, so none gathers in one task.

A line is dropped if an equal line, of any length, occurs earlier: in a document
with a smaller id, or further up in the same one; or if a line within the
threshold does and both have ``MIN_CHARS`` characters at least. Blank lines
always stay.

Defined results: null text stays null and has no lines; null ids come last in
order; equal rows (id and text) are one document that stays in all its copies;
empty tables give no rows; all columns of the input are kept, whatever their
names; the added ones have the names given. Texts are used whole. Everything is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, stored, table

EDITS = 2
MIN_CHARS = 24
#: Shared keys are broadcast up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: Lines of a key beyond which it is split, and how many times over.
HOT_KEY, LEVELS = 256, 2
#: The share of lines (one in so many) that is looked at for common keys, and how often those hold a key.
SHARE, COMMON = 64, 100
#: Bound of the lines, and of the common keys, that are broadcast.
HOT_LINES, HOT_KEYS = 100_000, 100_000


def _plan(edits: int) -> Column:
    """The index and probe keys of any line: (segment, length less, shift, is_index)."""
    out, parts = [], edits + 1
    for less in range(parts):
        for i in range(parts):
            after = edits - i
            out += [(i, less, shift, less == 0 and shift == 0) for shift in range(max(-i, less - after), min(i, less + after) + 1)]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(k, ("i", "less", "shift", "is_index"))]) for k in out])


def _keyed(rows: DataFrame, text: str, edits: int, *keep: str, rest: str | None = None, under: str | None = None) -> DataFrame:
    """One row per key of ``text``: ``keep``, ``is_index`` and ``key``, and the text without the segment as ``rest``.

    Keys below the key ``under`` hold for that key only.
    """
    parts = edits + 1
    # four bytes a character, so that segments are cut without a search for their place
    rows = rows.select(*keep, F.encode(text, "UTF-32").alias("_wide"), F.length(text).alias("_n")).select("*", F.inline(_plan(edits)))
    rows = rows.withColumn("_len", F.expr("_n - less")).withColumn("_start", F.expr(f"cast(_len * i div {parts} as int)"))
    rows = rows.withColumn("_size", F.expr(f"cast(_len * (i + 1) div {parts} as int) - _start")).withColumn("_start", F.expr("_start + shift"))
    own = F.xxhash64("i", "_len", F.expr("substring(_wide, 4 * _start + 1, 4 * _size)"))
    rest_of = [] if rest is None else [F.decode(F.expr("concat(substring(_wide, 1, 4 * _start), substring(_wide, 4 * (_start + _size) + 1))"), "UTF-32").alias(rest)]
    return rows.select(*[c for c in keep if c not in (under, "up")], (F.col("is_index") & F.col("up") if under else F.col("is_index")).alias("is_index"), (F.xxhash64(under, own) if under else own).alias("key"), *rest_of)


def lines_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Every line that is not blank: row key, order of its document, number, text and its two hashes."""
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("number", "line"),
    )
    return rows.where((F.length("line") >= min_chars) & (F.trim("line") != "")).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(EDITS), "line")})


def shared_keys(lines: DataFrame, edits: int) -> DataFrame:
    """Keys that at least two of the distinct lines (``h, line``) have, with the lines that hold them: ``key, h``."""
    # a line's 63 bits and the mark of its index keys travel as one number
    keyed = _keyed(lines, "line", edits, "h").select("key", F.expr("shiftleft(h, 1) | cast(is_index as int)").alias("x"))
    # where common keys are: this decides how rows are dealt, not what is found
    some = _keyed(lines.where(F.pmod(F.col("h"), F.lit(SHARE)) == 0), "line", edits, "h")
    common = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    common = checkpointed(common.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("common")))
    at, known = F.col("key"), F.lit(False)
    if not common.isEmpty():
        keyed, known = keyed.join(F.broadcast(common), "key", "left"), F.col("common")
        keyed = keyed.withColumn("at", F.when(known, F.xxhash64("key", "x")).otherwise(F.col("key")))
        at = F.col("at")
    line = F.expr("shiftright(x, 1)")
    of_key = W.partitionBy(at)
    met = keyed.withColumns({"least": F.min(line).over(of_key), "most": F.max(line).over(of_key), "indexed": F.max(F.expr("x & 1")).over(of_key)})
    return met.where(known | F.expr("least < most AND indexed = 1")).select("key", F.expr("shiftleft(shiftright(x, 1), 1)").alias("h")).distinct()


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """The distinct lines under the keys they share: all their columns, ``key, is_index``; checkpointed."""
    shared = checkpointed(shared_keys(lines, edits))
    keys, ends = shared.select("key").distinct(), shared.select("h").distinct()
    if shared.count() <= BROADCAST_KEYS:
        keys, ends = F.broadcast(keys), F.broadcast(ends)
    held = lines.withColumn("_even", F.expr("shiftleft(h, 1)")).join(ends.withColumnRenamed("h", "_even"), "_even", "left_semi").drop("_even")
    columns = held.columns
    rows = _keyed(held, "line", edits, *columns, rest="rest").join(keys, "key", "left_semi").dropDuplicates(["key", "is_index", "h"])
    done = []
    for _ in range(LEVELS):
        rows = checkpointed(rows)
        hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT_KEY).select("key"))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        deeper = rows.join(hot, "key", "left_semi").withColumnsRenamed({"key": "above", "is_index": "up"})
        rows = _keyed(deeper, "rest", edits, *columns, "above", "up", rest="rest", under="above").dropDuplicates(["key", "is_index", "h"])
        alone = rows.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most").select("key")
        rows = rows.join(alone, "key", "left_semi")
    for more in done:
        rows = rows.unionByName(more)
    return checkpointed(rows.drop("rest")) if done else rows.drop("rest")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within ``edits``: exact banded edit distance."""
    return (F.abs(F.length(a) - F.length(b)) <= edits) & (F.levenshtein(a, b, edits) >= 0)


def within_by_bits(a: Column, b: Column, edits: int) -> Column:
    """The same for two arrays of characters, by bit-parallel steps over the band's 2 * edits + 1 diagonals.

    One number holds, for each count of edits, which diagonals are reached. Each
    character of ``b`` moves them all at once by its match mask. ``within`` is
    faster, as Spark interprets the steps; the README has the figures.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    level = lambda state, e: F.shiftright(state, width * e).bitwiseAND(F.lit(full))

    def step(state: Column, j: Column) -> Column:
        c = F.get(b, j)
        mask = sum((F.when(F.get(a, j + (d - edits)) == c, 1 << d).otherwise(0) for d in range(width)), F.lit(0))
        # matched; or one edit more: put in another character, or skip one of b
        moved = [level(state, 0).bitwiseAND(mask)]
        for e in range(1, edits + 1):
            before = level(state, e - 1)
            moved.append(level(state, e).bitwiseAND(mask).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)))
        out = F.lit(0)
        for e in range(edits + 1):  # or skip characters of a, as many as there are edits left
            reached = moved[e]
            for less in range(1, e + 1):
                reached = reached.bitwiseOR(F.shiftleft(moved[e - less], less))
            out = out.bitwiseOR(F.shiftleft(reached.bitwiseAND(F.lit(full)), width * e))
        return out

    start = sum(sum(1 << (edits + d) for d in range(e + 1)) << (width * e) for e in range(edits + 1))
    ends = F.size(a) - F.size(b)
    last = F.when(F.size(b) == 0, F.lit(start)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.lit(start), step))
    diagonal = F.coalesce(F.get(F.array(*[F.lit(1 << d) for d in range(width)]), ends + edits), F.lit(0))
    return level(last, edits).bitwiseAND(diagonal) != 0


def _pairs(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """Rows of lines within ``edits`` that share a key, ``left`` by its index: ``x`` and ``y``."""
    x = left.where("is_index").select("key", F.struct(*[c for c in left.columns if c not in ("key", "is_index")]).alias("x"))
    y = right.select("key", F.struct(*[c for c in right.columns if c not in ("key", "is_index")]).alias("y"))
    return x.join(y, (x["key"] == y["key"]) & (F.col("x.h") != F.col("y.h")) & within(F.col("x.line"), F.col("y.line"), edits)).select("x", "y")


def links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """All pairs of hashes of different lines within ``edits``: ``a < b``, each once."""
    rows = candidates(lines.select("h", "line").dropDuplicates(["h"]), edits)
    return _pairs(rows, rows, edits).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()


def near_earlier(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Of distinct lines ``h, g, first, line`` those with another within ``edits`` whose ``first`` is smaller: ``h, g``."""
    rows = candidates(lines.select("h", "g", "first", "line"), edits)
    earliest = rows.groupBy("key").agg(F.min(F.struct("first", "line")).alias("e"))
    by_first = rows.join(earliest, "key").where((F.col("first") > F.col("e.first")) & within(F.col("line"), F.col("e.line"), edits))
    settled = checkpointed(by_first.select("h", "g").distinct())
    few = settled.count() <= BROADCAST_KEYS
    left = rows.join(F.broadcast(settled) if few else settled, ["h", "g"], "left_anti")
    # the earlier line of a pair may be settled, the later one is not
    found = _pairs(rows, left, edits).where("x.first < y.first").select("y.h", "y.g").unionByName(_pairs(left, rows, edits).where("y.first < x.first").select("x.h", "x.g"))
    return settled.unionByName(found).distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str, str] = ("n_lines", "n_repeated", "n_near")) -> DataFrame:
    """All rows and columns, with repeated lines cut from the text.

    Adds three numbers: lines, lines dropped as equal to an earlier line, and
    lines dropped as near an earlier, different line only. Input columns of
    these names are replaced; ``added`` gives others.
    """
    lines = lines_of(docs, 1, id_col, text_col)
    place = F.struct("doc", "row", "number")
    long_enough = F.when(F.length("line") >= min_chars, F.col("line"))
    first = stored(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min(long_enough).alias("line")))
    near = near_earlier(first.where("line IS NOT NULL"), edits).withColumn("near", F.lit(True))
    judged = checkpointed(first.drop("line").join(near, ["h", "g"], "left").where("n > 1 OR near"))
    # fewer than HOT_LINES lines can hold more than that share of all occurrences
    total = judged.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > max(1000, total // HOT_LINES)
    hot = judged.where(common).select("h", "g", F.struct("first", "near").alias("hot"))
    own = judged.where(~common).select(F.col("h").alias("at"), "g", F.struct("first", "near").alias("own"))
    told = lines.select("row", "doc", "number", "h", "g").join(F.broadcast(hot), ["h", "g"], "left")
    # occurrences of common lines know their answer and are spread
    told = told.withColumn("at", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("row", "number"))).join(own, ["at", "g"], "left")
    told = told.withColumn("judged", F.coalesce("hot", "own")).withColumn("repeated", place != F.col("judged.first"))
    by_row = told.where("repeated OR judged.near").groupBy("row").agg(
        F.collect_set("number").alias("_dedup_cut"),
        F.count_distinct(F.when(F.col("repeated"), F.col("number"))).cast("int").alias("_dedup_repeated"),
    )
    keyed = docs.withColumn("_dedup_row", F.xxhash64(F.col(id_col), F.col(text_col)))
    out = keyed.join(by_row.withColumnRenamed("row", "_dedup_row"), "_dedup_row", "left")
    all_lines = F.split(F.col(text_col), "\n")
    kept = F.filter(all_lines, lambda _, i: ~F.array_contains(F.col("_dedup_cut"), i))
    size = F.coalesce(F.size("_dedup_cut"), F.lit(0))
    return out.withColumns({
        added[0]: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)),
        added[1]: F.coalesce("_dedup_repeated", F.lit(0)),
        added[2]: F.when(F.col("_dedup_cut").isNull(), 0).otherwise(size - F.col("_dedup_repeated")),
        text_col: F.when(F.col("_dedup_cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    }).drop("_dedup_row", "_dedup_cut", "_dedup_repeated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that occur earlier, up to two edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_repeated", "n_near", "text")


def _sql() -> str:
    # DuckDB's distance counts bytes, so letters outside ASCII are first mapped one to one to control characters
    letters = "áéíóúñäöüßèêçàÁÉÍÓÚÑÄÖÜÈÊÇ"
    mapped = "".join(map(chr, (*range(1, 9), *range(14, 32))))
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS number, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT line, min({{'doc': doc_id, 'number': number}}) AS first, length(line) AS n, translate(line, '{letters}', '{mapped}') AS t
      FROM l WHERE trim(line) <> '' GROUP BY line),
e AS (SELECT * FROM f WHERE n >= {MIN_CHARS}),
near AS (SELECT DISTINCT y.line FROM e x JOIN e y ON x.n BETWEEN y.n - {EDITS} AND y.n + {EDITS} AND x.first < y.first AND x.line <> y.line
         AND levenshtein(x.t, y.t) <= {EDITS}),
j AS (SELECT l.doc_id, l.number, l.line, coalesce({{'doc': l.doc_id, 'number': l.number}} <> f.first, false) AS repeated, near.line IS NOT NULL AS near
      FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line),
o AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (repeated) AS INTEGER) AS n_repeated,
             CAST(count(*) FILTER (near AND NOT repeated) AS INTEGER) AS n_near,
             coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT repeated AND NOT near), '') AS text FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_repeated, n_near, text FROM o"""


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL = {"op3_line_dedup": _sql()}
