"""Merkle manifest of a table: a tree of hashes for each source, one over the sources, and a proof for each row.

Leaves are the rows' hashes, ordered within their source; every three neighbours become their hash until one node is
left, and so do the sources' last nodes. All nodes are a table ``tree, level, at, hash``. A proof is a lookup: from a
leaf's place and its tree's size follow the coordinates of the siblings on its way up, which are exploded, joined with
the node table, put in order, and folded. Below ``HEIGHT`` levels each leaf asks for itself; what lies above is the
same for all leaves of a stretch, so the stretch asks once, and no node is asked for by more than ``FAN ** HEIGHT``
rows but near the top, where stretches are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import small, table, written

#: Nodes that make one of the next level, and levels that are made, or asked for, at once.
FAN, HEIGHT = 3, 7
#: Rows that a range holds, about, when rows are put in order; levels that a tree can have at most (64-bit sizes).
ROWS, LEVELS = 250_000, 39
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def shown(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[shown(v) for v in values]), 256))


def _hex(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def _div(value: Column, by: int) -> Column:
    """Whole-number division of numbers from 0 on."""
    return F.call_function("div", value, F.lit(by))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, a row's place (from 0) in its ``tree`` by ``order`` (nulls first), and the tree's ``size``.

    Rows are cut into ranges of about ``ROWS``, ranked within them, and the rows of earlier ranges are added, so a
    tree that holds most rows is still put in order by many tasks. ``order`` must end in what tells all rows apart.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    laid = written(rows.repartitionByRange(parts, tree, *order).withColumn("_part", F.spark_partition_id()), "manifest-laid")
    sizes = laid.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    sizes = sizes.select(tree, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("size"))
    rank = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order)) - 1
    ranked = laid.withColumn("_rank", rank).join(sizes, [tree, "_part"])
    return ranked.withColumn("at", F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def _wide(size: Column, level: int) -> Column:
    """How many nodes a level of a tree has."""
    return _div(size - 1, FAN**level) + 1


def _parents(below: Column) -> Column:
    """The hashes of every ``FAN`` neighbours of an array that is not empty."""
    runs = F.sequence(F.lit(0), _div(F.size(below) - 1, FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FAN + 1, F.lit(FAN)), ""), 256))


def _placed(hashes: Column, level: int, wide: int) -> Column:
    """Nodes of a level of a stretch, which has ``wide`` of them at most; none where it has no such level."""
    found = F.transform(hashes, lambda h, i: F.struct(F.lit(level).alias("level"), (F.col("_run") * wide + i).alias("at"), F.unhex(h).alias("hash")))
    return F.coalesce(found, F.array().cast("array<struct<level:int,at:bigint,hash:binary>>"))


def nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above ``leaves`` (``tree, at, size, hash``): ``tree, level, at, size, hash``, the leaves at level 0.

    Each job groups stretches of ``FAN ** HEIGHT`` neighbours, a bounded number, and makes ``HEIGHT`` levels of each;
    there are as many jobs as that goes into the largest tree's levels.
    """
    here = leaves.select("tree", F.lit(0).alias("level"), "at", "size", "hash")
    found, low = here, 0
    most = here.agg(F.max("size")).first()[0] or 0
    while -(-most // FAN**low) > 1:
        rows = here.where(_wide(F.col("size"), low) > 1)
        rows = rows.groupBy("tree", _div(F.col("at"), FAN**HEIGHT).alias("_run")).agg(F.first("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda n: _hex(n["hash"])).alias("_0"))
        for k in range(HEIGHT):
            rows = rows.withColumn(f"_{k + 1}", F.when(_wide(F.col("size"), low + k) > 1, _parents(F.col(f"_{k}"))))
        made = F.concat(*[_placed(F.col(f"_{k}"), low + k, FAN ** (HEIGHT - k)) for k in range(1, HEIGHT + 1)])
        level = written(rows.select("tree", "size", F.explode(made).alias("n")).select("tree", "n.level", "n.at", "size", "n.hash"), "manifest-nodes")
        found, low = found.unionByName(level), low + HEIGHT
        here = level.where(F.col("level") == low)
    return found


def last(found: DataFrame) -> DataFrame:
    """``tree, hash`` of the node that is left of each tree."""
    top = [F.when(_wide(F.col("size"), k) > 1, 1).otherwise(0) for k in range(LEVELS)]
    height = sum(top[1:], top[0])
    return found.where(F.col("level") == height).select("tree", "hash")


def _siblings(low: int, high: int) -> Column:
    """Coordinates ``level, at, left`` of the siblings on the way up from ``at`` in a tree of ``size``, between two levels."""

    def of(level: int) -> Column:
        own, wide = _div(F.col("at"), FAN**level), _wide(F.col("size"), level)
        first = _div(own, FAN) * FAN
        run = F.transform(F.sequence(first, F.least(first + (FAN - 1), wide - 1)), lambda i: F.struct(F.lit(level).alias("level"), i.alias("at"), (i < own).alias("left")))
        return F.when(wide > 1, F.filter(run, lambda c: c["at"] != own)).otherwise(F.array().cast("array<struct<level:int,at:bigint,left:boolean>>"))

    return F.concat(*[of(k) for k in range(low, high)])


def proofs(members: DataFrame, found: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """``members`` (``tree, at`` at level 0, ``size``) by ``key``, with ``path``: left and right siblings, level by level.

    Coordinates are exploded and looked up in the node table; a level without siblings has an empty entry.
    """
    asked = members.select(*key, "tree", "size", F.explode_outer(_siblings(low, high)).alias("c")).select(*key, "tree", "size", "c.level", F.col("c.at").alias("_at"), "c.left")
    table_ = found.where((F.col("level") >= low) & (F.col("level") < high)).select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("at").alias("_place"), "hash")
    met = asked.join(table_, (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("_at") == F.col("_place")), "left")
    own = [c for c in key if c != "tree"]
    lists = met.groupBy("tree", *own).agg(F.first("size").alias("_size"), F.sort_array(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "_at", "left", "hash")))).alias("_s"))
    levels = F.filter(F.sequence(F.lit(low), F.lit(high - 1)), lambda k: _more(F.col("_size"), k))

    def side(k: Column, left: bool) -> Column:
        return F.array_join(F.transform(F.filter("_s", lambda s: (s["level"] == k) & (s["left"] == F.lit(left))), lambda s: _hex(s["hash"])), "")

    path = F.transform(levels, lambda k: F.struct(side(k, True).alias("l"), side(k, False).alias("r")))
    return lists.select("tree", *own, path.alias("path"))


def _more(size: Column, level: Column) -> Column:
    """Whether a level of a tree has several nodes, so that they get parents."""
    powers = F.lit([FAN**k for k in range(LEVELS)]).cast("array<bigint>")
    return size > F.get(powers, level)


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.aggregate(path, hash_, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``fields`` are hashed in this order; ``doc_id`` orders the leaves of a ``source``. ``tampered``: expressions that
    stand for some fields when the root is recomputed. Null sources are a source of their own, the first; null ids
    come first in theirs; rows that share an id follow each other by their hash, so equal rows can be told from each
    other by nothing but their place. A source with one row has its leaf as last node, one source is the root. Texts
    of any length are hashed whole, in the task that reads them. An empty table gives no rows; other columns are not
    read.
    """
    change = tampered or {}
    leaves = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), leaf_hash([F.col(f) for f in fields]).alias("hash"), leaf_hash([change.get(f, F.col(f)) for f in fields]).alias("now"))
    leaves = written(leaves, "manifest-leaves")
    sources = written(numbered(leaves.select(F.lit(0).alias("tree"), "_source").distinct(), "tree", "_source").select(F.col("at").alias("tree"), F.col("size").alias("_of"), F.col("_source").alias("_name")), "manifest-sources")
    placed = leaves.join(small(sources, sources.count()), F.col("_source").eqNullSafe(F.col("_name")))
    placed = written(numbered(placed.select("row", "_id", "hash", "now", "tree", "_of"), "tree", "_id", "hash", "row"), "manifest-placed")
    found = nodes(placed)
    roots = written(last(found), "manifest-roots")
    trees = written(roots.join(sources.select("tree", F.col("_of").alias("size")), "tree").select(F.lit(0).alias("tree"), F.col("tree").alias("at"), "size", "hash"), "manifest-trees")
    above = nodes(trees)
    root = last(above).select(F.col("tree").alias("_zero"), F.col("hash").alias("_root"))
    tops = proofs(trees, above, ["tree", "at"], 0, LEVELS).join(trees.select("at", "hash"), "at").join(F.broadcast(root), F.col("tree") == F.col("_zero"))
    tops = tops.select(F.col("at").alias("_tree"), F.col("path").alias("_top"), F.col("hash").alias("_subroot"), "_root")
    run = _div(F.col("at"), FAN**HEIGHT)
    heads = placed.where(F.col("at") % FAN**HEIGHT == 0).select("tree", "at", "size", run.alias("_run"))
    heads = proofs(heads, found, ["tree", "_run"], HEIGHT, LEVELS)
    heads = written(heads.join(tops, F.col("tree") == F.col("_tree")).select(F.col("tree").alias("_t"), F.col("_run").alias("_r"), F.concat("path", "_top").alias("_above"), "_subroot", "_root"), "manifest-heads")
    own = proofs(placed.select("row", "tree", "at", "size"), found, ["row", "tree"], 0, HEIGHT).select("row", "path")
    rows = placed.select("row", "_id", "hash", "now", "tree", run.alias("_run")).join(own, "row").join(heads, (F.col("tree") == F.col("_t")) & (F.col("_run") == F.col("_r")))
    rows = rows.withColumn("path", F.concat("path", "_above"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    rows = rows.select(F.col("_id").alias("doc_id"), _hex(F.col("hash")).alias("leaf"), _hex(F.col("_subroot")).alias("subroot"), _hex(F.col("_root")).alias("root"), proof.alias("proof_sha256"), folded(_hex(F.col("now")), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where 2 divides the CRC-32 of an id, line feeds are taken out of the text before
    the root is recomputed. Null ids are not tampered with, and null texts stay."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


def sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII expression in DuckDB, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))"
    turn = "CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}::BIGINT[]), lambda a, x: {turn}), 4294967295::BIGINT)"


def _sql(levels: int = 12) -> str:
    """The same by one step of SQL a level, for sources of 3 ** ``levels`` rows at most."""
    shown_ = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = "||".join(shown_(c) for c in FIELDS[:-1])
    out = [f"""b AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({head} || {shown_('text')}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {sql_crc32('doc_id::VARCHAR')} % 2 = 0 THEN sha256({head} || {shown_("replace(text, chr(10), '')")}) ELSE sha256({head} || {shown_('text')}) END AS now FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM b)"""]

    def up(name: str, first: str) -> None:
        out.append(f"{name}0 AS MATERIALIZED ({first})")
        for k in range(levels):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (size + 2) // 3 AS size, CASE WHEN size > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY tree, pos // 3, size)")

    def ways(name: str, first: str, nodes_: str) -> None:
        """The fold ``f`` and the proof ``p`` of each ``id``."""
        out.append(f"{name}0 AS MATERIALIZED ({first})")
        for k in range(levels):
            side = lambda c: f"coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos {c} w.pos), '')"
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT id, tree, pos // 3 AS pos, (size + 2) // 3 AS size, CASE WHEN size > 1 THEN sha256(l || f || r) ELSE f END AS f, p || l || r AS p
  FROM (SELECT w.id, w.tree, w.pos, w.size, w.f, w.p, {side('<')} AS l, {side('>')} AS r FROM {name}{k} w LEFT JOIN {nodes_}{k} n ON n.tree = w.tree AND n.pos // 3 = w.pos // 3 GROUP BY ALL))""")

    up("n", "SELECT tree, pos, size, leaf AS h FROM l")
    up("t", f"SELECT 0 AS tree, tree AS pos, count(*) OVER () AS size, h FROM n{levels}")
    ways("w", "SELECT doc_id AS id, tree, pos, size, now AS f, '' AS p FROM l", "n")
    ways("v", f"SELECT id, 0 AS tree, tree AS pos, (SELECT count(*) FROM t0) AS size, f, p FROM w{levels}", "t")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, n{levels}.h AS subroot, t{levels}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t{levels}.h AS verified FROM l JOIN n{levels} USING (tree) JOIN v{levels} v ON v.id = l.doc_id, t{levels}"


SQL = _sql()
