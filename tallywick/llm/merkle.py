"""Operator 4 (native): document fingerprints from a Merkle tree.

A text is cut at line ends into paragraphs (a paragraph of many characters into
pieces of at most ``PIECE`` code points, counted from its start).  Leaves are 128
bits of the pieces' SHA-256.  A section ends with a leaf whose hash starts with a
zero digit (one in 16 does), so that an insertion changes the section it falls
into and no later one.  Sections hash their leaves, the root hashes the sections:
equal roots mean equal texts, and differing branches locate edits.  A fingerprint
is the root followed by a bottom-k sketch of the leaves, from which two
fingerprints' likeness (share of common leaves, exact up to ``SKETCH`` distinct
leaves) follows.

A null text is empty and has the tree of no leaf; two empty texts have likeness
1.  Texts of any length are cut in one pass.  Rows with the same id each keep a
row of their own.  The next document is the one with the next greater id (of
several with that id: the smallest text); after the greatest, and for a null id,
the first; where none has an id, each is its own.  A single document is its own next.  An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 48
SKETCH = 64
#: Documents in a block of neighbouring ids, on average (a block is what a task
#: sorts), and the most blocks, which bounds the list of their first ids.
BLOCK = 500
BLOCKS_MOST = 20_000


def leaves(text: Column) -> Column:
    """Hashes of the pieces of paragraphs, in order.  The lookaround-free
    pattern takes each character once, however long a text is."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PIECE}}}\\n?|\\n)"), 1)
    return F.transform(pieces, lambda p: F.substring(F.sha2(p.cast("binary"), 256), 1, 32))


def section_ends(leaf_hashes: Column) -> Column:
    """Numbers (from 1) of the leaves that end a section."""
    n = F.size(leaf_hashes)
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda i: (i == n) | F.get(leaf_hashes, i - 1).startswith("0"))


def sections(leaf_hashes: Column, ends: Column) -> Column:
    """Hashes of the runs of leaves up to each of ``ends``.  Both must be columns."""

    def one(end: Column, k: Column) -> Column:
        before = F.coalesce(F.get(ends, k - 1), F.lit(0))
        return F.sha2(F.array_join(F.slice(leaf_hashes, before + 1, end - before), "").cast("binary"), 256)

    return F.transform(ends, one)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds leaves, sections (arrays of strings), root and fingerprint of the
    column ``text``, each name after ``prefix``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn(f"{prefix}leaves", leaves(t))
    df = df.withColumn(f"{prefix}_ends", section_ends(F.col(f"{prefix}leaves")))
    df = df.withColumn(f"{prefix}sections", sections(F.col(f"{prefix}leaves"), F.col(f"{prefix}_ends"))).drop(f"{prefix}_ends")
    df = df.withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}sections", "").cast("binary"), 256))
    low = F.slice(F.array_sort(F.array_distinct(F.transform(f"{prefix}leaves", lambda h: F.upper(F.substring(h, 23, 10))))), 1, SKETCH)
    return df.withColumn(f"{prefix}fingerprint", F.concat(F.substring(f"{prefix}root", 1, 32), F.lit(":"), F.array_join(low, "")))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns, 0 to 1, from the strings alone."""
    split = lambda c: F.regexp_extract_all(F.substring(F.col(c), 34, 10 * SKETCH), F.lit("([0-9A-F]{10})"), 1)
    union = F.slice(F.array_sort(F.array_union(split(a), split(b))), 1, SKETCH)
    both = F.array_intersect(F.array_intersect(union, split(a)), split(b))
    shared = F.size(both) / F.size(union)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).when(F.size(union) == 0, F.lit(0.0)).otherwise(shared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, leaves, sections, root and fingerprint of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_tree(rows, "text").drop("text")


def edited_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two versions of a table of :func:`fingerprints` differ: doc_id, the
    numbers (from 0) of the sections and leaves of the first version that the
    second hasn't, and of those of the second (new_sections, new_leaves) that the
    first hasn't.  Only documents whose roots differ are compared further."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col("x.doc_id") == F.col("y.doc_id")).where(F.col("x.root") != F.col("y.root"))

    def only(one: str, other: str) -> Column:
        gone = F.array_except(F.col(one), F.col(other))
        numbers = F.transform(F.col(one), lambda h, k: F.when(F.array_contains(F.col("_gone"), h), k))
        return gone, F.filter(numbers, lambda k: k.isNotNull())

    for name, one, other in (("sections", "x.sections", "y.sections"), ("leaves", "x.leaves", "y.leaves"), ("new_sections", "y.sections", "x.sections"), ("new_leaves", "y.leaves", "x.leaves")):
        gone, numbers = only(one, other)
        both = both.withColumn("_gone", gone).withColumn(f"_{name}", numbers).drop("_gone")
    return both.select(F.col("x.doc_id").alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in ("sections", "leaves", "new_sections", "new_leaves")])


def _longs(values: list[int]) -> Column:
    """A list of numbers as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _edges_until(edges: list[int], value: Column, equal: bool) -> Column:
    """How many of the sorted ``edges`` are below ``value`` (or equal to it)."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))]) if edges else F.array().cast("array<int>")
    at = lambda found, step: F.get(_longs(edges), found + step - 1)
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when((at(found, step) <= value) if equal else (at(found, step) < value), found + step).otherwise(found))


def _blocks(edges: list[int], lonely: int) -> Column:
    """The block of a doc_id: ids from one edge to the next.  An id that is
    several edges is dealt out over as many blocks, and rows without id over
    ``lonely`` blocks below 0."""
    id_, deal = F.col("doc_id"), F.monotonically_increasing_id()
    upper, lower = _edges_until(edges, id_, True), _edges_until(edges, id_, False)
    spread = F.when(upper - lower > 1, lower + 1 + F.pmod(deal, (upper - lower).cast("long"))).otherwise(upper)
    return F.when(id_.isNull(), -1 - F.pmod(deal, F.lit(lonely))).otherwise(spread).cast("long")


def with_next(rows: DataFrame, tree: bool = False) -> DataFrame:
    """Adds next_text of the document with the next greater doc_id to rows of
    doc_id and text, and with ``tree`` the fingerprint of either text.

    Blocks of neighbouring ids are cut at quantiles of the ids, and rows are
    shuffled once, by block; the first row after a block goes into it as its end
    mark.  In a block sorted from the greatest id down, the row before the first
    of an id is what follows that id."""
    low, n, lonely = rows.agg(F.min("doc_id"), F.count("doc_id"), F.count("*") - F.count("doc_id")).first()
    count = min(max(1, n // BLOCK), BLOCKS_MOST)
    edges = []
    if count > 1:
        shares = [k / count for k in range(1, count)]
        edges = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * count)).alias("e")).first().e
    lonely = min(max(1, lonely // BLOCK), BLOCKS_MOST)
    base = rows.withColumn("_block", _blocks(edges, lonely))
    marks = {}  # block: the least id that is greater than all of its ids
    if low is not None:
        following = low
        for k in range(len(edges), -1, -1):
            marks[k] = following
            if k and (k == 1 or edges[k - 2] < edges[k - 1]):
                following = edges[k - 1]
        if len(set(edges)) < len(edges):
            # the blocks that hold nothing but a frequent id end where their last block goes on
            own = F.when(F.col("_block") > 0, F.get(_longs(edges), F.col("_block").cast("int") - 1))
            more = {r[0]: r[1] for r in base.where("_block > 0").groupBy("_block").agg(F.min(F.when(F.col("doc_id") > own, F.col("doc_id")))).collect()}
            last = {e: k for k, e in enumerate(edges, 1)}
            for k, e in enumerate(edges, 1):
                if k < last[e]:
                    marks[k] = marks[k] if more.get(last[e]) is None else more[last[e]]
        marks |= {-1 - k: low for k in range(lonely)}
    wanted = rows.sparkSession.range(1).select(F.explode(F.arrays_zip(_longs(list(marks)).alias("b"), _longs(list(marks.values())).alias("i"))).alias("m")).select(F.col("m.b").alias("_block"), F.col("m.i").alias("_id"))
    # at most two numbers for each of 2 * BLOCKS_MOST blocks
    wanted = F.broadcast(wanted)
    ends = rows.join(F.broadcast(wanted.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    if tree:
        base, ends = with_tree(base, "text").select(*base.columns, "fingerprint"), with_tree(ends, "text").select("doc_id", "text", "fingerprint")
    ends = ends.join(wanted, F.col("doc_id") == F.col("_id")).drop("_id")
    both = base.withColumn("_end", F.lit(False)).unionByName(ends.withColumn("_end", F.lit(True)))
    carried = ["text", "fingerprint"] if tree else ["text"]
    down = Window.partitionBy("_block").orderBy(F.desc("_end"), F.desc("doc_id"), F.desc("text"))
    found = both.withColumn("_before", F.lag(F.struct("_end", "doc_id", *carried)).over(down))
    found = found.withColumn("_before", F.when(F.col("_before._end") | ~F.col("_before.doc_id").eqNullSafe(F.col("doc_id")), F.col("_before")))
    found = found.withColumn("_before", F.last("_before", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(~F.col("_end"))
    return found.select("doc_id", *carried, *[F.coalesce(F.col(f"_before.{c}"), F.col(c)).alias(f"next_{c}") for c in carried])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text (its last
    quarter replaced by the head of the next document) and the likeness to the
    edited text's and the next document's fingerprint."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pairs = with_next(rows, tree=True)
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _cut)"), F.expr("substring(next_text, 1, _cut)"))
    pairs = pairs.withColumn("edited", edited)
    pairs = with_tree(pairs, "edited", "edited_")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
