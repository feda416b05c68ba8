"""A Merkle manifest of a dataset: leaves, subtree roots, one root, and a proof for every row.

Leaves of one language stand in order of doc_id; every FAN consecutive nodes have their hash as parent, level by
level, until one node is left: the subroot. Subroots, in order of language, build the top tree in the same way.

Levels are windows. All nodes of a span of FAN ** LEVELS leaves are in one small window partition, where the first
row of each node's leaves stands for the node. Per level, lag and lead columns at fixed offsets, masked by the node's
slot and its run's length, supply its siblings, and the rows of first children hash the parents. What the span's first row
holds then is a node of the next pass, so a pass shrinks the table by FAN ** LEVELS, whatever the language.
Going down again, each row takes its span's path from the pass above.

Defined cases: null values of the five columns are "-"; a null doc_id comes first; rows with one doc_id are ordered by
leaf, and rows that are equal throughout are told apart by their row number alone, which changes no hash; null lang is a
tree of its own, first; a null doc_id is never tampered with; an empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import ascii_lower, crc32_sql, spread_join, stored, table
from assaykit.llm.places import placed

FAN, LEVELS = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed, row): ``changed`` is the leaf after tampering, null for rows left alone."""
    values = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        # "-" sorts before "=": null comes first, then bytewise
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(*map(field, values)).alias("leaf"),
        F.when(tampered, digest(*map(field, values[:-1]), field(ascii_lower(F.col("text"))))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def climbed(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Siblings and parents of ``levels`` levels of (tree, n, pos, value): columns ``left{l}``, ``right{l}``, ``value{l}``.

    ``n`` is the number of nodes of the tree. The row at a multiple of fan ** l stands for a node of level l; siblings are null at
    levels where the tree has a single node, which is handed on as it is.
    """
    span = fan**levels
    inside = Window.partitionBy("tree", "span").orderBy("pos")
    out = nodes.withColumn("span", F.expr(f"pos div {span}")).withColumn("value0", F.col("value"))
    for level in range(levels):
        step = fan**level
        many = F.expr(f"(n + {step - 1}) div {step}")
        place = F.expr(f"pos div {step}")
        slot = place % fan
        run = F.least(F.lit(fan), many - (place - slot))
        own = F.col(f"value{level}")
        stands = (F.col("pos") % step == 0) & (many > 1)
        left = F.concat(*[F.when(slot >= k, F.lag(own, k * step).over(inside)).otherwise("") for k in range(fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + k < run, F.lead(own, k * step).over(inside)).otherwise("") for k in range(1, fan)])
        out = out.withColumns({f"left{level}": F.when(stands, left), f"right{level}": F.when(stands, right)})
        parent = F.when(many > 1, digest(own, F.col(f"right{level}"))).otherwise(own)
        out = out.withColumn(f"value{level + 1}", F.when(F.col("pos") % (step * fan) == 0, parent))
    return out


def passes(nodes: DataFrame, what: str, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes``, then the nodes of every ``levels``-th level above them, until each tree is one node."""
    span, made = fan**levels, [nodes]
    while (made[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tops = climbed(made[-1], fan, levels).where(F.col("pos") % span == 0)
        up = tops.select("tree", F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.expr(f"pos div {span}").alias("pos"), F.col(f"value{levels}").alias("value"))
        made.append(stored(up, what))
    return made


def with_paths(made: list[DataFrame], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The first table of ``passes`` with ``path``: siblings left and right, level by level to the tree's root."""
    above = None
    upto = Window.partitionBy("tree", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if len(made) == 1:
        return made[0].withColumn("path", F.array().cast(_PATH))
    for nodes in reversed(made[:-1]):
        steps = []
        for level in range(levels):
            # the last row before this one that stands for a node stands for this row's node
            left, right = ((F.col(f"{side}{level}") if level == 0 else F.last(f"{side}{level}", ignorenulls=True).over(upto)) for side in ("left", "right"))
            steps.append(F.struct(left.alias("left"), right.alias("right")))
        own = climbed(nodes, fan, levels).withColumn("path", F.filter(F.array(*steps), lambda s: s["left"].isNotNull()))
        own = own.select(*nodes.columns, "span", "path")
        if above is not None:
            own = own.join(above, ["tree", "span"]).withColumn("path", F.concat("path", "above"))
        above = own.select("tree", F.col("pos").alias("span"), F.col("path").alias("above"))
    return own.select(*nodes.columns, "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """One digest of all siblings, from the leaf's to the root's children, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, tree, leaf, changed, subroot, root, path): one row per document; ``path`` holds its siblings up to the root."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    rows = placed(stored(leaves(docs), "leaves"), "tree", order, "leaves-in-order")
    own = passes(rows.select("tree", "n", "pos", F.col("leaf").alias("value"), "doc_id", "changed"), "nodes", fan, levels)
    subroots = own[-1].where("pos = 0").select(F.col("tree").alias("name"), "value")
    top = placed(stored(subroots.withColumn("tree", F.lit("")), "subroots"), "tree", [F.col("name")], "subroots-in-order")
    tops = passes(top, "tops", fan, levels)
    roots = tops[-1].select("tree", F.col("value").alias("root"))
    trees = with_paths(tops, fan, levels).join(roots, "tree").select(F.col("name").alias("tree"), F.col("value").alias("subroot"), "root", F.col("path").alias("upper"))
    every = spread_join(with_paths(own, fan, levels), trees, "tree")
    return every.select("doc_id", "tree", F.col("value").alias("leaf"), "changed", "subroot", "root", F.concat("path", "upper").alias("path"))


def checked(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The manifest with each row's proof, and the root folded from its leaf as it is after tampering."""
    rows = manifest(docs, fan, levels)
    folded = rows.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path"))).withColumn("proof_sha256", proof(F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERY = "op12_merkle_manifest"


def _sql_leaf(text: str) -> str:
    one = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(one, ["doc_id", "source", "lang", "n_chars", text])) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_sql_leaf('text')} AS leaf,
         CASE WHEN {crc32_sql("doc_id")} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_sql_leaf('text')} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
below AS (SELECT tree, max(level) AS height FROM low GROUP BY tree),
nodes AS (SELECT tree, level, pos, n, h FROM low UNION ALL SELECT t.tree, b.height + level, o.pos, o.n, o.h FROM top o, subroots t JOIN below b USING (tree) WHERE o.n > 1),
steps AS (
  SELECT p.tree, p.pos, x.level,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < here), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > here), '') AS r
  FROM (SELECT p.tree, p.pos, k.level, CASE WHEN k.level < b.height THEN p.pos // (8 ** k.level)::BIGINT ELSE s.pos // (8 ** (k.level - b.height))::BIGINT END AS here
        FROM placed p JOIN below b USING (tree) JOIN subroots s USING (tree) JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) k USING (tree)) p
  JOIN nodes x ON x.tree = p.tree AND x.level = p.level AND x.n > 1 AND x.pos // 8 = here // 8
  GROUP BY p.tree, p.pos, x.level),
paths AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS siblings FROM steps GROUP BY tree, pos),
folds AS (
  SELECT p.tree, p.pos, 0 AS i, p.changed AS h, coalesce(q.path, []) AS path FROM placed p LEFT JOIN paths q ON q.tree = p.tree AND q.pos = p.pos
  UNION ALL
  SELECT tree, pos, i + 1, sha256(path[i + 1].l || h || path[i + 1].r), path FROM folds WHERE i < len(path))
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subroots s USING (tree) LEFT JOIN paths q ON q.tree = p.tree AND q.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.i = len(f.path), root
"""


def query(spark, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "documents"))
