"""Merkle manifest of a dataset: a tree per language, a tree over their roots, and a proof per document.

A leaf is the print of a row's fields. The leaves of a group, in order of id, are hashed in runs of
``FANOUT`` to parents, level by level, until one node is left; the groups' roots, in order of the
group, make the root in the same way. A document's proof are the siblings on its way to the root.

Every level is lag and lead columns of one window. The nodes of a level stand at the rows of their
first leaves, so those of one run are a fixed number of rows apart: masked by the node's slot in its
run and by the length of the run, lag and lead give the siblings, and the row in slot 0 hashes the
parent. A window holds ``2 ** LEVELS`` neighbours of a group, never a group: what it leaves, one node
per window, is a table so many times smaller, to which the same is done, until every group has one
node. Proofs come back down by joins of each table with the next smaller one, which is the only
side to be exchanged. Places in a group come from one range exchange and the counts of its parts.

Results for odd input: a null field is written ``-``; null ids come first, null groups too; rows of
one id are ordered by leaf, and equal rows are leaves of their own; without an id no count is
tampered with; a group of one leaf is its own root, and a tree of one such group has empty proofs;
texts may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import documents

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels that one window climbs.
LEVELS = 10
# A step of a proof is a mark and the sibling: which side of it the node goes to, or that there is none.
LEFT, RIGHT, ALONE = "<", ">", "="


def print_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Print of fields, each with its length in bytes."""
    spelled = [f.cast("string") for f in fields]
    return print_of(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in spelled])


def _stored(table: DataFrame, path: str) -> DataFrame:
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def _placed(nodes: DataFrame, order: list[Column], path: str) -> DataFrame:
    """``group, node`` and ``own`` with their place (from 0) in their ``group`` and the group's ``size``.

    Rows are numbered where a range exchange put them; a number is made a place by the sizes of the
    parts before, of which there are as many as partitions and groups.
    """
    dealt = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order).select("group", "node", "own")
    dealt = _stored(dealt.withColumn("number", F.monotonically_increasing_id()), path).withColumn("part", F.shiftright("number", 33))
    parts = dealt.groupBy("group", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("number").alias("first"))
    whole = Window.partitionBy("group")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    parts = parts.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("size"))
    return dealt.join(parts, ["group", "part"]).select("group", "node", "own", (F.col("number") + F.col("shift")).alias("place"), "size")


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """Rows of ``group, own, place, size, node`` with the steps of their proof inside their block of ``2 ** levels`` places.

    The row that begins a block also has the node on ``top`` of it. ``size`` is the number of nodes of the group.
    """
    rows = nodes.withColumn("block", F.shiftright("place", levels))
    here = Window.partitionBy("group", "block").orderBy("place")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = [*(c for c in ("own", "leaf") if c in nodes.columns), "group", "block", "place", "size"]
    for level in range(levels + 1):
        apart = 1 << level
        # The step of a node stands at its first row; the rows under it, which follow, take it over.
        filled = [F.last(f"step{k}", ignorenulls=True).over(so_far).alias(f"step{k}") for k in range(level - 1, level) if k >= 0]
        steps = [f"step{k}" for k in range(level - 1)]
        if level == levels:
            rows = rows.select(*keep, "node", *steps, *filled)
            break
        seen = rows.select(*keep, "node", *steps, *filled, F.lead("node", apart).over(here).alias("after"), F.lag("node", apart).over(here).alias("before"))
        first = F.col("place") % apart == 0
        slot = F.shiftright("place", level) % 2
        # Nodes of this level: one per 2 ** level leaves, the last of fewer. With one left the tree is done.
        open_ = F.col("size") > apart
        paired = F.col("place") + apart < F.col("size")
        step = F.when(slot == 1, F.concat(F.lit(LEFT), "before")).when(paired, F.concat(F.lit(RIGHT), "after")).otherwise(F.lit(ALONE))
        parent = F.when(paired, print_of(F.col("node"), F.col("after"))).otherwise(print_of(F.col("node")))
        rows = seen.withColumns(
            {
                f"step{level}": F.when(first & open_, step).when(first, F.lit("")),
                "node": F.when(first & ~open_, F.col("node")).when(first & (slot == 0), parent),
            }
        ).drop("after", "before")
    steps = F.filter(F.array(*[F.col(f"step{k}") for k in range(levels)]), lambda s: s != "")
    return rows.select(*keep, F.when(F.shiftleft("block", levels) == F.col("place"), F.col("node")).alias("top"), steps.alias("steps"))


def grown(leaves: DataFrame, order: list[Column], levels: int, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """A tree per ``group`` over the ``node`` of its rows: a table of steps for every ``levels`` levels, and ``group, top``."""
    nodes, tables = _placed(leaves, order, f"{folder}/placed").withColumn("leaf", F.col("node")), []
    while True:
        # Read again for the proofs: climbing twice is cheaper than to keep the steps of all rows.
        tables.append(_climbed(nodes, levels))
        tops = tables[-1].filter("top IS NOT NULL").select(
            "group", F.col("block").alias("place"), F.ceil(F.col("size") / (1 << levels)).alias("size"), F.col("top").alias("node")
        )
        nodes = _stored(tops, f"{folder}/{len(tables)}")
        if nodes.filter("size > 1").isEmpty():
            return tables, nodes.select("group", F.col("node").alias("top"))


def proven(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves with all steps of their proofs, and the ``shared`` column of ``above``, which has a group's last ``steps``."""
    above = above.select("group", F.lit(0).cast("long").alias("block"), "shared", F.col("steps").alias("more"))
    for k, rows in reversed(list(enumerate(tables))):
        # A table of windows is dealt by block already; only the smaller one that it meets is exchanged.
        done = rows.join(above, ["group", "block"]).withColumn("steps", F.concat("steps", "more"))
        above = done.select("group", F.col("place").alias("block"), "shared", F.col("steps").alias("more"))
    return done.select("own", "leaf", "shared", "steps")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(node: Column, sibling: Column) -> Column:
        mark, other = F.left(sibling, F.lit(1)), F.substring(sibling, 2, 64)
        return F.when(mark == LEFT, print_of(other, node)).when(mark == RIGHT, print_of(node, other)).otherwise(print_of(node))

    return F.aggregate(steps, start, step)


def manifest(rows: DataFrame, leaf_of: Column, group: Column, order: list[str], *, also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``order`` and ``also`` columns of each row with ``leaf, subroot, root`` and ``steps``, the siblings on its way to the root.

    A group is null or a string; groups follow each other by their bytes, null first.
    """
    folder = scratch_path(rows.sparkSession, "merkle")
    own = F.struct(*[F.col(c) for c in order], *[c.alias(n) for n, c in (also or {}).items()])
    spelled = F.coalesce(F.concat(F.lit("+"), group), F.lit(""))
    # One pass reads the rows, what is sorted and joined afterwards is narrow. A number tells equal rows
    # apart, so that any number of them can be dealt to several tasks.
    leaves = rows.select(spelled.alias("group"), leaf_of.alias("node"), own.alias("own")).withColumn("row", F.monotonically_increasing_id())
    by_id = [*[F.asc_nulls_first(f"own.{c}") for c in order], F.asc("node"), F.asc("row")]
    tables, tops = grown(_stored(leaves, f"{folder}/leaves"), by_id, levels, f"{folder}/groups")
    roots = tops.select(F.lit("").alias("group"), F.col("top").alias("node"), F.struct("group", "top").alias("own"))
    last, root = grown(roots, [F.asc("own.group")], levels, f"{folder}/root")
    last = proven(last, root.select("group", F.col("top").alias("shared"), F.array().cast("array<string>").alias("steps")))
    above = last.select("own.group", F.struct(F.col("own.top").alias("subroot"), F.col("shared").alias("root")).alias("shared"), "steps")
    return proven(tables, above).select("own.*", "leaf", "shared.*", "steps")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    changed = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    # Rows that are not tampered with keep their leaf; a text is hashed a second time for the others alone.
    done = manifest(docs, leaf(*fields), F.col("lang"), ["doc_id"], also={"changed": F.when(tampered, leaf(*changed))})
    siblings = F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), "")
    again = folded(F.coalesce("changed", "leaf"), F.col("steps"))
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


# crc32 goes bit by bit over the digits of the id; nodes climb to one per group, then groups to one; a tampered leaf is
# folded up by recursion. Equal rows are told apart by ``k``.
OP12_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, n_chars, concat_ws('', s_id, s_source, s_lang) AS head, s_text AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') AS s_id,
    coalesce(strlen(source) || ':' || source, '-') AS s_source, coalesce(strlen(lang) || ':' || lang, '-') AS s_lang,
    coalesce(strlen(text) || ':' || text, '-') AS s_text FROM documents)
), hashed AS (
  SELECT *, row_number() OVER () AS k, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other
  FROM rows_
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS place,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp
  FROM hashed
), nodes AS (
  SELECT grp, 0 AS level, place, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, max(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM nodes) WHERE n > 1 GROUP BY grp, place // 2
), tops AS (
  SELECT grp, level AS height, digest AS subroot FROM (SELECT *, max(level) OVER (PARTITION BY grp) AS highest FROM nodes) WHERE level = highest
), upper_ AS (
  SELECT 0 AS level, grp AS place, subroot AS digest FROM tops
  UNION ALL
  SELECT max(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_) WHERE n > 1 GROUP BY place // 2
), peak AS (SELECT level AS height, digest AS root FROM upper_ ORDER BY level DESC LIMIT 1
), steps AS (
  SELECT l.k, n.level, n.place, s.digest AS sibling FROM leaves l JOIN tops t USING (grp)
    JOIN nodes n ON n.grp = l.grp AND n.level < t.height AND n.place = l.place >> n.level
    LEFT JOIN nodes s ON s.grp = n.grp AND s.level = n.level AND s.place = xor(n.place, 1)
  UNION ALL
  SELECT l.k, t.height + u.level, u.place, s.digest FROM leaves l JOIN tops t USING (grp) CROSS JOIN peak p
    JOIN upper_ u ON u.level < p.height AND u.place = l.grp >> u.level
    LEFT JOIN upper_ s ON s.level = u.level AND s.place = xor(u.place, 1)
), folded AS (
  SELECT k, 0 AS level, CASE WHEN tampered THEN other ELSE leaf END AS digest FROM leaves
  UNION ALL
  SELECT f.k, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.digest WHEN s.place % 2 = 0 THEN f.digest || s.sibling
    ELSE s.sibling || f.digest END)
  FROM folded f JOIN steps s ON s.k = f.k AND s.level = f.level
), proofs AS (
  SELECT k, string_agg(sibling, '' ORDER BY level) AS siblings FROM steps GROUP BY k
), ends AS (SELECT k, arg_max(digest, level) AS folded_root FROM folded GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN tops USING (grp) CROSS JOIN peak LEFT JOIN proofs USING (k) JOIN ends USING (k)
"""
