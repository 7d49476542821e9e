"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines within one edit share a variant with at most one character deleted. Variants are emitted as
hashed keys, equal keys are joined, the edit distance is verified, and of near lines the earliest stays.

Only lines that can have a partner emit variants: of two lines within one edit, either the first or the
last half (rounded down to a multiple of ANCHOR) is equal, so a line none of whose halves occurs in a
different line is left out. That test is exact, and it also tells in which half the edit lies. A
variant's key is the exclusive or of the hashes of its BLOCK-sized pieces with their places, so a line
of n characters costs n hashes of BLOCK characters however long it is.

Later exact repeats go at every length, from `shortest` characters on (1 by default: all lines that are not blank;
blank lines part paragraphs and stay). One-edit variants are looked for from MIN_CHARS on: of shorter lines one
character is too large a part to call them the same ("Yes." and "Yet.", list numbers, table cells).

Lines are named by 64-bit hashes; a line's place is (doc_id, hash of the document's text, line number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, save

#: Shorter lines have no one-edit variants; production value, as in LINES_SQL.
MIN_CHARS = 20
#: Tasks that the places of one line are spread over.
SPREAD = 8
ANCHOR, BLOCK = 4, 64
#: Filter of lines whose text is shuffled: bits by hash in bitmaps of 4 KB, 16 MB in all, whatever the input.
FILTER_BITS, BITMAP_BITS = 27, 15


def _left(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


def _right(c: Column, n: Column) -> Column:
    return F.substring(c, F.length(c) - n + 1, n)


def lines_of(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """doc_id, d2 (hash of the text), line_no, line, h: the lines of MIN_CHARS and more of every whole text, and
    those of shortest and more that are not blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("d2"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = F.length("line") >= MIN_CHARS
    wanted = long | ((F.length("line") >= shortest) & F.col("line").rlike(r"[^\x20\x09-\x0D]")) if shortest < MIN_CHARS else long
    return rows.filter(wanted).withColumn("h", F.xxhash64("line"))


def _anchors(line: Column) -> Column:
    """Hashes of the first and last half, and where one more character would move the cut, of that cut too."""
    n = F.length(line)
    cell = F.floor(n / (2 * ANCHOR)).cast("int") * ANCHOR
    keys = lambda size: [F.struct(F.xxhash64(F.lit("p"), size, _left(line, size)).alias("key"), F.lit(True).alias("head")), F.struct(F.xxhash64(F.lit("s"), size, _right(line, size)).alias("key"), F.lit(False).alias("head"))]
    own = F.array(*keys(cell))
    return F.when(n % (2 * ANCHOR) == 2 * ANCHOR - 1, F.concat(own, F.array(*keys(cell + ANCHOR)))).otherwise(own)


def _bit_filter(rows: DataFrame) -> DataFrame:
    """Bitmaps (bucket, bits) of the hashes in column h."""
    place = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    marks = rows.select(F.shiftright(place, BITMAP_BITS).alias("bucket"), place.bitwiseAND((1 << BITMAP_BITS) - 1).alias("bit"))
    return marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _in_filter(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose h has its bit set (all that were marked, and few others); the bitmaps are broadcast."""
    place = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place.bitwiseAND((1 << BITMAP_BITS) - 1), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.shiftright(place, BITMAP_BITS)).join(F.broadcast(bits), "bucket")
    mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place.bitwiseAND(7) + 1).cast("int"))
    return found.filter(byte.bitwiseAND(mask) != 0).drop("bucket", "bits")


def _xor(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def variants(rows: DataFrame) -> DataFrame:
    """h and key: of each line itself and of it without one character, where lo..hi (blocks) allow one.

    rows: h, line, lo, hi.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    named = lambda c: F.transform(cut(c), lambda x, i: F.xxhash64(i, x))
    after = F.substring(F.col("line"), F.lit(2), F.length("line"))
    rows = rows.select("h", "lo", "hi", cut(F.col("line")).alias("b"), named(F.col("line")).alias("at"), named(after).alias("next"))
    # The blocks before the deleted character stay in place, those after it are the ones cut a character later.
    j = F.col("j")
    block = rows.select("h", "b", "at", "next", F.explode(F.sequence("lo", F.least("hi", F.size("b") - 1))).alias("j"))
    rest = _xor(F.slice("at", F.lit(1), j)).bitwiseXOR(_xor(F.slice("next", j + 2, F.greatest(F.size("next") - j - 1, F.lit(0)))))
    piece = F.concat(F.get("b", j), F.coalesce(_left(F.get("b", j + 1), F.lit(1)), F.lit("")))
    block = block.select("h", "j", rest.alias("rest"), piece.alias("piece"), F.length(F.get("b", j)).alias("size"))
    less = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.concat(_left(F.col("piece"), i - 1), F.substring(F.col("piece"), i + 1, F.length("piece"))))
    # A last block of one character leaves nothing behind, and nothing has no hash.
    keys = F.transform(less, lambda x: F.when(x == "", F.col("rest")).otherwise(F.col("rest").bitwiseXOR(F.xxhash64(F.col("j"), x))))
    own = rows.select("h", _xor(F.col("at")).alias("key"))
    return own.unionByName(block.select("h", F.explode(F.array_distinct(keys)).alias("key")))


def near_lines(docs: DataFrame, shortest: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (without text), h, place of the first occurrence and number n of occurrences of every distinct line, and the pairs (a, b)
    of different lines within one edit."""
    lines = lines_of(docs, shortest)
    anchors = _anchors(F.col("line"))
    if shortest < MIN_CHARS:
        anchors = F.when(F.length("line") >= MIN_CHARS, anchors)
    place = F.struct("doc_id", "d2", "line_no")
    seen = lines.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first(anchors).alias("anchors"))
    seen = save(seen.select("h", "place", "n", "anchors"))
    keys = seen.select("h", F.explode("anchors").alias("k")).select("h", "k.key", "k.head")
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("key")
    able = save(keys.join(shared, "key", "left_semi").groupBy("h").agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail")))
    # An equal first half leaves the edit to the blocks behind it, an equal last half to those before it.
    texts = _in_filter(lines.select("h", "line"), _bit_filter(able)).dropDuplicates(["h"]).join(able.hint("merge"), "h")
    cell = F.floor(F.length("line") / (2 * ANCHOR)).cast("int") * ANCHOR
    lo = F.when(F.col("tail"), F.lit(0)).otherwise(F.floor(cell / BLOCK).cast("int"))
    hi = F.when(F.col("head"), F.floor((F.length("line") - 1) / BLOCK)).otherwise(F.floor((F.length("line") - cell) / BLOCK)).cast("int")
    texts = save(texts.select("h", "line", lo.alias("lo"), hi.alias("hi")))
    made = variants(texts)
    pairs = made.withColumnRenamed("h", "a").join(made.withColumnRenamed("h", "b"), "key").filter("a < b").select("a", "b").distinct()
    text = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias(f"_{c}"))
    pairs = save(pairs.join(text("a"), "a").join(text("b"), "b").filter(F.levenshtein("_a", "_b", 1) >= 0).select("a", "b"))
    drop_saved(able, texts)
    return lines, seen.select("h", "place", "n"), pairs


def dropped_lines(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """doc_id, d2, gone (array of line numbers): of the lines of MIN_CHARS and more, those equal to or within one edit
    of an earlier one; of shorter ones, from shortest on and not blank, those equal to an earlier one.

    Earlier goes by doc_id (null first), hash of the text, line number; a line counts as earlier whether
    it stays itself or not.
    """
    lines, seen, pairs = near_lines(docs, shortest)
    first = lambda c: seen.select(F.col("h").alias(c), F.col("place").alias(f"_{c}"))
    both = pairs.join(first("a"), "a").join(first("b"), "b")
    late = both.select(F.when(F.col("_a") < F.col("_b"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct().withColumn("late", F.lit(True))
    known = seen.join(late, "h", "left").select("h", "n", F.col("place").alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    known = save(known.filter("late or n > 1"))
    # Only lines of which some place goes are looked up, and a very common one is spread over SPREAD tasks.
    here = _in_filter(lines.select("h", F.struct("doc_id", "d2", "line_no").alias("place")), _bit_filter(known))
    here = here.withColumn("_s", F.pmod(F.xxhash64("place"), F.lit(SPREAD)))
    known = known.drop("n").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    gone = here.join(known.hint("merge"), ["h", "_s"]).filter(F.col("late") | ~F.col("place").eqNullSafe(F.col("first")))
    return gone.groupBy("place.doc_id", "place.d2").agg(F.collect_set("place.line_no").alias("gone"))


def without_lines(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """All columns of docs with text without the dropped lines, and _lines and _gone, the numbers of its lines
    before and of those dropped.

    Null texts stay null; a text all of whose lines go is empty. Repeated rows (equal doc_id and text)
    are one document in several copies and lose the same lines; texts that share a doc_id do not count
    as one. An empty table gives an empty table.
    """
    columns = docs.columns
    gone = dropped_lines(docs, shortest).select(F.col("doc_id").alias("_id"), F.col("d2").alias("_d2"), F.col("gone").alias("_list"))
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_in")).withColumn("_t", F.col("_in.text").cast("string"))
    rows = rows.join(gone, F.col("_in.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("_t") == F.col("_d2")), "left")
    split = F.split("_t", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_list"))
    rows = rows.withColumn("_parts", split)
    text = F.when(F.col("_list").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_parts", i)), "\n"))
    counts = [F.coalesce(F.size("_parts"), F.lit(0)), F.coalesce(F.size("_list"), F.lit(0))]
    rows = rows.select("_in", text.alias("_text"), *(F.greatest(c, F.lit(0)).cast("long").alias(k) for k, c in zip(("_lines", "_gone"), counts, strict=True)))
    return rows.select(*(F.col("_text").alias(c) if c == "text" else F.col("_in")[c].alias(c) for c in columns), "_lines", "_gone")


def dedup(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and text, what is left of it."""
    rows = without_lines(docs.select("doc_id", "text"), shortest)
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), "text")


def clean_documents(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """The documents with all their columns, text without dropped lines and n_chars, where there is one, to match."""
    rows = without_lines(docs, shortest).drop("_lines", "_gone")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
