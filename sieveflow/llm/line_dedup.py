"""Line dedup by a deletion-neighbourhood join: edit distance of at most one character.

A line of ``MIN_CHARS`` or more goes if an earlier line of the corpus (by document id, then place) is
within one edit of it, itself included in neither sense: the earlier line need not have stayed.
Shorter lines always stay.

1. Equal lines are grouped by a 128-bit digest; a row for each different line goes on.
2. One edit leaves the first or the last q characters of both lines as they are, for any q up to half
   of the shorter. Lines that share neither with any other line, for a q by length, can't have a
   neighbour and go no further. This is exact and takes out nearly all.
3. The same with 8 and then 64 blocks, of which one edit leaves all but one: lines go further only if
   they share all but one block with another line of their length or one more or less.
4. What is left emits the hashes of all its variants with one character deleted. A line is cut into
   blocks, and a variant's hash is made of those of what is before its block, of the block without the
   character, and of what is after; the outer ones are chained from block to block, so a variant costs
   a block and not a line. Lines of one length that share a variant at the same place differ in that
   character alone (a substitution), so the earliest of each such group is found by a minimum, without
   pairs. A line is an insertion away from another if the other, hashed as if a character lacked in one
   of its blocks, equals a variant. Variants have 128 bits, so a minimum isn't that of a collision.
5. Each line and the earliest line found are compared character by character before anything goes.

Only hashes and places are shuffled up to the end, when each document meets its dropped places.

Cases: a null text stays null and an empty one empty; a document all of whose lines go has an empty
text; rows repeated with id and text share their decisions; of rows with one id and different texts
the lesser hash comes first; a null id comes last; other columns stay as they are, whatever their
names (the numbers of lines take the next free name, see :func:`line_dedup`); an empty table gives no
rows. Lines are compared whole, at a cost that grows with the length to the power of 4 / 3 for lines
that have a neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

MIN_CHARS = 20
#: Blocks of a line in the second look and the third.
BLOCKS = (8, 64)
#: Bound of the rows that are broadcast to fetch lines; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """th (hash of the text), id, pos, line, n (its length): the lines that may go."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return d.withColumn("n", F.length("line")).where(F.col("n") >= MIN_CHARS)


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")


def _halves(line: str) -> Column:
    """Hashes of the first and last q characters, q at most half of the length, and of the length less one.

    q takes steps of a quarter, so that lines of nearly equal length mostly have one q.
    """
    n = F.length(line)
    # log in base 1.25 of n / MIN_CHARS picks the step without a search.
    q = lambda m: F.floor(F.lit(MIN_CHARS / 2) * F.pow(F.lit(1.25), F.floor(F.log(m / F.lit(float(MIN_CHARS))) / math.log(1.25) + 1e-9))).cast("int")
    one = lambda m: [F.xxhash64(F.lit(0), q(m), F.substring(line, F.lit(1), q(m))), F.xxhash64(F.lit(1), q(m), F.right(line, q(m)))]
    shorter = F.greatest(n - 1, F.lit(MIN_CHARS))
    return F.array_distinct(F.array(*one(n), *one(shorter)))


def _share_all_but_one(got: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``got`` (no, line, n) whose line shares all but one of its blocks with another's."""
    # The pair's shorter line has m characters; without block i, a beginning and an end are left, which
    # are those of the longer line too.
    but_one = F.expr(
        f"flatten(transform(array(n, n - 1), m -> transform(sequence(0, {blocks - 1}), i -> "
        f"xxhash64(m, i, left(line, int(m * i div {blocks})), right(line, int(m - m * (i + 1) div {blocks}))))))"
    )
    keyed = got.select("no", F.explode(but_one).alias("k"))
    met = keyed.groupBy("k").agg(F.count("*").alias("times")).where("times > 1").select("k")
    kept = keyed.join(met, "k", "left_semi").select("no").distinct()
    return got.join(kept, "no", "left_semi")


def _block(n: str) -> str:
    """Characters of a block of a line of ``n``, in SQL: the third root, four times, and 64 at least."""
    return f"greatest(64, cast(4 * cbrt({n}) as int))"


def _chains(blocks: str, seed: int) -> str:
    """SQL: the hashes of what is before each block of an array and, at its end, of the whole."""
    return f"aggregate({blocks}, array(xxhash64({seed})), (a, b) -> concat(a, array(xxhash64(element_at(a, -1), {seed}, b))))"


def _keyed_blocks(got: DataFrame, n: str, tail: str) -> DataFrame:
    """``got`` with, for the block length of a line of ``n`` characters: k (that length), here (the blocks of the
    line), and four chains: what is before each block, and after it, in two hashes each.

    ``tail`` is SQL for the line from the second block on, as blocks that follow are cut from it.
    """
    cutting = "regexp_extract_all({}, concat('(?s).{{1,', cast(k as string), '}}'), 0)"
    out = got.withColumn("k", F.expr(_block(n))).withColumn("here", F.expr(cutting.format("line")))
    out = out.withColumn("rest", F.expr("reverse(" + cutting.format(tail) + ")"))
    return out.withColumns({f"{c}{i}": F.expr(_chains(a, i)) for c, a in (("b", "here"), ("a", "rest")) for i in (1, 2)})


def variants_of(got: DataFrame) -> DataFrame:
    """no, n, at, v, w: 128 bits of each variant of a line (no, line, n) with the character ``at`` (from 0) deleted."""
    cut_up = _keyed_blocks(got, "n", "substring(line, k + 1)")
    each = cut_up.select("no", "n", "k", F.size("here").alias("m"), "b1", "b2", "a1", "a2", F.posexplode("here").alias("j", "block"))
    key = lambda i: f"xxhash64(b{i}[j], {i}, concat(left(block, c - 1), substring(block, c + 1)), a{i}[m - 1 - j])"
    inner = F.expr(f"transform(sequence(1, length(block)), c -> named_struct('at', j * k + c - 1, 'v', {key(1)}, 'w', {key(2)}))")
    return each.select("no", "n", F.inline(inner))


def lacking_one(got: DataFrame) -> DataFrame:
    """other, m, v, w: each line of m characters as the variant that a line of m + 1 has in any of its blocks."""
    cut_up = _keyed_blocks(got, "n + 1", "substring(line, k)")
    # The blocks of the longer line: the last may have but the character that lacks here.
    blocks = "cast(ceil((n + 1) / k) as int)"
    key = lambda i: f"xxhash64(b{i}[j], {i}, left(coalesce(get(here, j), ''), k - 1), a{i}[{blocks} - 1 - j])"
    inner = F.expr(f"transform(sequence(0, {blocks} - 1), j -> named_struct('v', {key(1)}, 'w', {key(2)}))")
    return cut_up.select(F.col("no").alias("other"), F.col("n").alias("m"), F.inline(inner))


def near_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(different lines, the digests of those that have an earlier neighbour). See the steps above."""
    spark = lines.sparkSession
    digest = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.reverse("line")).alias("h2")]
    known = lines.select("id", "th", "pos", *digest, _halves("line").alias("halves"))
    different = known.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves"))
    different = cut(different, "different-lines")

    keyed = different.select("h1", "h2", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    maybe = keyed.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    maybe = cut(maybe.join(different.select("h1", "h2", "first"), ["h1", "h2"]), "maybe")

    # Fetch their text from where each is first.
    places = maybe.select("h1", "h2", "first", F.col("first.id").alias("id"), F.col("first.th").alias("th"), F.col("first.pos").alias("pos"))
    small = places.count() <= BROADCAST_ROWS
    at = (lines.id.eqNullSafe(places.id)) & (lines.th == places.th) & (lines.pos == places.pos)
    got = lines.join(places.hint("broadcast" if small else "shuffle_hash"), at).select("h1", "h2", "first", "line")
    # A number in the order of the corpus, so that least means earliest. Repeated rows fetch a line twice.
    got = got.dropDuplicates(["h1", "h2"]).repartitionByRange("first").sortWithinPartitions("first")
    got = cut(got.select(F.monotonically_increasing_id().alias("no"), "h1", "h2", "line", F.length("line").alias("n")), "lines")

    for blocks in BLOCKS:
        got = cut(_share_all_but_one(got, blocks), "close-lines")

    variants = variants_of(got)
    groups = variants.groupBy("v", "w", "at", "n").agg(F.min("no").alias("by"), F.max("no").alias("top"), F.count("*").alias("times")).where("times > 1")
    groups = cut(groups, "variants")
    two = groups.where("times = 2").select(F.col("top").alias("no"), "by", "at", "n")
    keys = groups.where("times > 2").select("v", "w", "at", "n", "by")
    many = variants.join(keys, ["v", "w", "at", "n"]).where("no > by").select("no", "by", "at", "n")
    inserted = variants.join(lacking_one(got), ["v", "w"]).where("m = n - 1")
    inserted = inserted.select(F.greatest("no", "other").alias("no"), F.least("no", "other").alias("by"), "at", "n")
    found = two.unionByName(many).unionByName(inserted).groupBy("no").agg(F.min(F.struct("by", "at", "n")).alias("found")).select("no", "found.*")
    a, b = got.select("no", "h1", "h2", "line"), got.select(F.col("no").alias("by"), F.col("line").alias("earlier"))
    # Both without the character in which they differ, or the longer without the one that the other lacks.
    less = lambda c: F.expr(f"if(length({c}) = n, concat(left({c}, at), substring({c}, at + 2)), {c})")
    sure = found.join(a, "no").join(b, "by").where(less("line") == less("earlier"))
    return different, cut(sure.select("h1", "h2", F.lit(True).alias("near")), "near-lines")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the text of the lines that stay, and the numbers of lines and of dropped lines.

    Where ``docs`` has a column ``n_lines`` or ``n_dropped`` it stays, and the number's name gets underscores at its end.
    """
    n_lines, n_dropped = free_name(n_lines, docs.columns), free_name(n_dropped, [*docs.columns, free_name(n_lines, docs.columns)])
    lines = _lines(docs, id_col, text_col)
    different, near = near_lines(lines)
    bad = different.join(near, ["h1", "h2"], "left").where((F.col("times") > 1) | F.col("near"))
    bad = bad.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    each = lines.select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.reverse("line")).alias("h2"))
    gone = each.join(bad, ["h1", "h2"]).where(F.col("near") | (_order() != F.col("first")))
    gone = cut(gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone-lines")

    t = F.col(text_col)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(t).alias("th"), F.split(t, "\n").alias("parts"))
    g = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone").hint("shuffle_hash")
    out = inner.join(g, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    # Places that stay are told by a hash set, and lines are fetched by their places: linear in the lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    stay = F.transform(places, lambda i: F.get(F.col("parts"), i))
    own = F.col("row").getField(text_col)
    text = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(stay, "\n"))
    cols = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    total = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long")
    return out.select(*cols, total.alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_dropped))
