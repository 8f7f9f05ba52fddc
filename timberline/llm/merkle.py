"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections, in DataFrame operators.

Sections are parted by a blank line, paragraphs by a line feed, sentences by a space behind ``. ! ?``. The
separators are fixed and every node hashes the whole SHA-256 of its children, so equal roots mean equal texts. A
fingerprint writes the tree from the root down, ``root:section[paragraph(sentence,sentence)...]...``, the root in
full and the other nodes by their first digits; two of them are compared branch by branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import table, written
from timberline.llm.exact import mark

#: Hex digits that a fingerprint shows of inner nodes and of leaves.
NODE, LEAF = 16, 12
#: Ranges of rows at most, rows that a range should hold, and bounds of ranges that are looked at in a line.
RANGES, ROWS, STEP = 65_536, 2_000, 256
LOWEST = -(2**63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once; as an expression within a lambda it would be made for every element."""
    return F.transform(F.array(value), body)[0]


def _hash(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), content), 256)


def _under(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["hash"]), "")


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string; null counts as empty."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    sentences = F.transform(sections, lambda s: F.transform(F.split(s, F.lit("\n"), -1), lambda p: F.transform(F.split(p, F.lit("(?<=[.!?]) "), -1), lambda x: _hash("s", x))))

    def paragraph(p: Column) -> Column:
        shown = F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF)), ",")
        return F.struct(_hash("p", F.array_join(p, "")).alias("hash"), F.concat(F.lit("("), shown, F.lit(")")).alias("shown"))

    def listed(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda n: F.concat(F.substring(n["hash"], 1, NODE), n["shown"])), "")

    def section(s: Column) -> Column:
        return F.struct(_hash("c", _under(s)).alias("hash"), F.concat(F.lit("["), listed(s), F.lit("]")).alias("shown"))

    tree = F.transform(F.transform(sentences, lambda s: F.transform(s, paragraph)), section)
    return _let(tree, lambda t: F.concat(_hash("r", _under(t)), F.lit(":"), listed(t)))


def leaves(print_: Column) -> Column:
    """The leaves of a fingerprint, each with the number of its occurrence: what two texts share can be counted."""

    def numbered(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def runs(first: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(first, k + 1), F.size(ordered))
                return F.transform(F.sequence(F.lit(1), end - start), lambda j: F.concat_ws(":", F.get(ordered, start), j))

            return F.flatten(F.transform(first, run))

        return _let(starts, runs)

    return _let(F.array_sort(F.filter(F.split(print_, "[^0-9a-f]+"), lambda h: F.length(h) == LEAF)), numbered)


def likeness(a: Column, b: Column, a_leaves: Column | None = None, b_leaves: Column | None = None) -> Column:
    """Share of leaves, repeated ones each, that two fingerprints have in common (Dice), 1 for equal ones."""
    x, y = (leaves(a) if a_leaves is None else a_leaves), (leaves(b) if b_leaves is None else b_leaves)
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def branches(print_: Column) -> Column:
    """The sections of a fingerprint, each with its hash and those of its paragraphs."""
    parts = F.filter(F.split(F.substring_index(print_, ":", -1), "\\]"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.substring(s, 1, NODE).alias("hash"), F.regexp_extract_all(s, F.lit(rf"([0-9a-f]{{{NODE}}})\("), F.lit(1)).alias("paragraphs")))


def differing(a: Column, b: Column) -> Column:
    """Where two trees (of ``branches``) differ: ``section, paragraph``, from 1, of every place that is not the same.

    The trees are descended side by side; nothing below equal sections is looked at. A place that only one of them
    has differs.
    """

    def apart(x: Column, y: Column, of: Callable[[Column], Column]) -> Column:
        pairs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z, i: F.struct((i + 1).alias("at"), z["x"].alias("x"), z["y"].alias("y")))
        return F.filter(pairs, lambda z: ~of(z["x"]).eqNullSafe(of(z["y"])))

    none = F.array().cast("array<string>")

    def places(s: Column) -> Column:
        inside = apart(F.coalesce(s["x"]["paragraphs"], none), F.coalesce(s["y"]["paragraphs"], none), lambda p: p)
        return F.transform(inside, lambda p: F.struct(s["at"].alias("section"), p["at"].alias("paragraph")))

    return F.flatten(F.transform(apart(a, b, lambda s: s["hash"]), places))


def _unsigned(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _ranged(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``docs`` (with ``_at``) and, for each row, its range, and whether it is the first row of it."""
    parts = min(RANGES, max(1, -(-docs.count() // rows)))
    heads = docs.select("_at").repartitionByRange(parts, "_at").groupBy(F.spark_partition_id().alias("part")).agg(F.min("_at").alias("head"))
    bounds = sorted(bytes(r.head) for r in heads.select("head").collect())
    steps = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    spark = docs.sparkSession
    known = spark.createDataFrame(list(enumerate(steps)), "_step int, _bounds array<binary>")

    def behind(sorted_: Column) -> Column:
        return F.size(F.filter(sorted_, lambda b: b <= F.col("_at"))) - 1

    first = F.array(*[F.lit(s[0]) for s in steps]) if steps else F.array().cast("array<binary>")
    placed = docs.withColumn("_step", behind(first)).join(F.broadcast(known), "_step")
    placed = placed.withColumn("_range", F.col("_step") * STEP + behind(F.col("_bounds")))
    return placed.withColumn("_head", F.get("_bounds", F.col("_range") - F.col("_step") * STEP) == F.col("_at")).drop("_step", "_bounds"), len(bounds)


def with_next(docs: DataFrame, columns: list[str], rows: int = ROWS, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``next_<column>`` of the next row by descending doc_id; the first row follows the last.

    Null ids come last; rows with one doc_id are in the order of the SHA-256 of their texts. The order is that of one
    binary key, unique to each row. Keys are cut into ranges of about ``rows`` rows, at bounds sampled from the keys
    alone, so neither outlying ids nor many rows of one id make a large range; there are ``RANGES`` at most, whose
    bounds (33 bytes each) are broadcast. Each range is ordered by itself; the head of the range behind is dealt to
    it as well, as a guard. Texts are numbered and written once and dealt once. ``made`` may add columns once the
    rows are dealt, so that these need not move. An empty table gives no rows.
    """
    at = F.concat(F.when(F.col("doc_id").isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), F.coalesce(_unsigned(F.bitwise_not(F.col("doc_id").cast("long").bitwiseXOR(F.lit(LOWEST)))), F.lit(b"")), mark(F.col("text")), _unsigned(F.monotonically_increasing_id()))
    placed, ranges = _ranged(written(docs.select("*", at.alias("_at")), "fingerprint-rows"), rows)
    above = F.pmod(F.col("_range") - 1, F.lit(max(ranges, 1)))
    to = F.when(F.col("_head"), F.array("_range", above)).otherwise(F.array("_range"))
    dealt = placed.select(*docs.columns, "_at", F.posexplode(to).alias("_guard", "_to")).repartition("_to")
    dealt = made(dealt) if made else dealt
    order = Window.partitionBy("_to").orderBy("_guard", "_at")
    found = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.where("_guard = 0").drop("_at", "_guard", "_to")


def compare(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``), as the query's contract has it, and ``changed``.

    ``changed`` lists the places (section and paragraph, from 1) that the edit touched, found by descending from the
    roots of both fingerprints along branches that differ. Null counts as empty; rows with one doc_id follow each
    other by the SHA-256 of their texts, null ids come last; a single row is followed by itself; an empty table gives
    no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, ["text", "fingerprint"], made=lambda d: d.withColumn("fingerprint", fingerprint(F.col("text"))))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    pairs = pairs.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    pairs = pairs.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        pairs = pairs.withColumn(f"_{name}", leaves(F.col(name)))

    def near(other: str) -> Column:
        return likeness(F.col("fingerprint"), F.col(other), F.col("_fingerprint"), F.col(f"_{other}"))

    changed = differing(branches(F.col("fingerprint")), branches(F.col("edited_fingerprint")))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), changed.alias("changed"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
