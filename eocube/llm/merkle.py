"""Merkle manifest of a dataset by nested-struct rollup.

A leaf is the hash of a row's fields. Leaves of a group (source) are numbered by doc_id, and the number is written in
digits of base ``FAN``. Digit columns are grouped away one by one, the children of a node nested in its struct, until a
block of ``FAN ** DEPTH`` leaves is one row. Blocks are the leaves of the next round, so a row never holds more than a
block; rounds end when each group is one block. The groups' roots are rolled up the same way.

Proofs come from above: a block meets the path above it (one shuffle by block), and its struct is taken apart digit by
digit with ``posexplode``, each child with its siblings to the left and right. Nothing is joined for it.

Edge cases: null fields are hashed as ``-``; null groups are a group of their own, the first; null doc_ids come first in
their group; equal doc_ids go by their leaf hash, and rows equal in all fields are leaves of their own; a group of one
row has its leaf as root; one group of one row has an empty proof; an empty table gives an empty result; other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import read

FAN, DEPTH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDES = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A field as it is hashed: its UTF-8 length, a colon and the value; null is ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", more: list[Column] | None = None) -> DataFrame:
    """``(g, item, node, ..)``: group as a sortable string, doc_id, leaf hash of each row, and columns made of the row."""
    return docs.select(_group(group_col), F.col(f"`{id_col}`").alias("item"), digest(*[field(F.col(f"`{c}`")) for c in fields]).alias("node"), *(more or []))


def _group(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")).alias("g")


def numbered(nodes: DataFrame) -> DataFrame:
    """A stored table ``(g, item, node, ..)`` with ``r``, the number in its group by (item, node), and ``n``, the group's rows.

    The rows are dealt by ranges, so a group may lie in many partitions; what is summed is a row for each run of a group
    in a partition. Rows that are equal in all parts are dealt on by their place in the stored table.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["g", "item", "node", "_tie"]
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    at = stage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)), "ordered-leaves")
    runs = at.groupBy("g", "_p").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy("g")
    runs = runs.select("g", "_p", "_first", F.sum("_k").over(group).alias("n"), (F.sum("_k").over(group.orderBy("_p")) - F.col("_k")).alias("_before"))
    return at.join(runs, ["g", "_p"]).withColumn("r", F.col("_before") + F.col("_at") - F.col("_first")).drop("_p", "_at", "_first", "_before")


def _width(level: int) -> Column:
    """Nodes of the group at a level."""
    return F.ceil(F.col("n") / F.lit(FAN**level))


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["node"]), "")


def block_trees(nodes: DataFrame) -> DataFrame:
    """``(g, n, b, node, kids)``: a row for each block of ``(g, item, node, r, n)``, its tree nested in ``kids``."""
    digits = [(F.floor(F.col("r") / F.lit(FAN**k)) % FAN).cast("int").alias(f"d{k}") for k in range(DEPTH)]
    rest = [F.col(c) for c in nodes.columns if c not in ("g", "n", "r")]
    t = nodes.select("g", "n", F.floor(F.col("r") / F.lit(FAN**DEPTH)).alias("b"), *digits, *rest).repartition("g", "b")
    held = [c for c in nodes.columns if c not in ("g", "n", "r", "node")]
    for k in range(DEPTH):
        kids = F.sort_array(F.collect_list(F.struct(f"d{k}", "node", *held))).alias("kids")
        t = t.groupBy("g", "n", "b", *[f"d{j}" for j in range(DEPTH - 1, k, -1)]).agg(kids)
        t = t.withColumn("node", F.when(_width(k) > 1, digest(_joined(F.col("kids")))).otherwise(F.col("kids")[0]["node"]))
        held = ["kids"]
    return t


def rollup(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored block trees of every round, from the leaves up; in the last each group is one block."""
    rounds = [stage(block_trees(nodes), f"{name}-tree")]
    while (rounds[-1].agg(F.max(_width(DEPTH))).first()[0] or 0) > 1:
        upper = rounds[-1].select("g", _width(DEPTH).alias("n"), F.col("b").alias("r"), F.lit(None).cast("string").alias("item"), "node")
        rounds.append(stage(block_trees(upper), f"{name}-tree"))
    return rounds


def unfold(trees: DataFrame, paths: DataFrame) -> DataFrame:
    """Leaves ``(g, r, node, item, .., sides, ..)`` of block trees under the ``paths`` ``(g, b, sides, ..)`` above the blocks.

    ``sides`` are the siblings to the left and right, level by level from the leaf up. Trees and paths meet as rows of
    one group; a block has one row of each.
    """
    more = [c for c in paths.columns if c not in ("g", "b", "sides")]
    t = trees.unionByName(paths, allowMissingColumns=True).repartition("g", "b").groupBy("g", "b").agg(*[F.first(c, True).alias(c) for c in ("n", "kids", "sides", *more)]).filter("kids is not null")
    t = t.withColumn("_place", F.lit(0).cast("bigint"))
    for k in range(DEPTH - 1, -1, -1):
        t = t.withColumn("_nodes", F.transform("kids", lambda x: x["node"])).select(*t.columns, "_nodes", F.posexplode("kids").alias("_i", "_kid")).drop("kids")
        side = F.struct(F.array_join(F.slice("_nodes", 1, F.col("_i")), "").alias("l"), F.array_join(F.slice("_nodes", F.col("_i") + 2, FAN), "").alias("r"))
        kid = [F.col("_kid.kids").alias("kids")] if k else [F.col("_kid")]
        t = t.select(
            "g", "b", "n", *more, *kid,
            (F.col("_place") * FAN + F.col(f"_kid.d{k}")).alias("_place"),
            F.when(_width(k) > 1, F.concat(F.array(side), F.col("sides"))).otherwise(F.col("sides")).alias("sides"),
        )
    held = [f for f in t.schema["_kid"].dataType.fieldNames() if f != "d0"]
    return t.select("g", (F.col("b") * F.lit(FAN**DEPTH) + F.col("_place")).alias("r"), *[F.col("_kid")[f].alias(f) for f in held], "sides", *more)


def manifest(nodes: DataFrame) -> DataFrame:
    """``(item, leaf, .., subroot, root, sides)`` of a stored table ``(g, item, node, ..)``; a row for each of its rows."""
    lower = rollup(numbered(nodes), "leaves")
    tops = stage(lower[-1].select(F.lit("").alias("g"), F.col("g").alias("item"), "node"), "group-roots")
    upper = rollup(numbered(tops), "groups")
    paths = upper[-1].select("g", "b", F.array().cast(_SIDES).alias("sides"), F.col("node").alias("root"))
    for t in reversed(upper[1:]):
        paths = unfold(t, paths).select("g", F.col("r").alias("b"), "sides", "root")
    paths = unfold(upper[0], paths).select(F.col("item").alias("g"), F.lit(0).cast("bigint").alias("b"), "sides", F.col("node").alias("subroot"), "root")
    for t in reversed(lower[1:]):
        paths = unfold(t, paths).select("g", F.col("r").alias("b"), "sides", "subroot", "root")
    return unfold(lower[0], paths).drop("g", "r").withColumnRenamed("node", "leaf")


def fold(leaf: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(sides, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def proof_digest(sides: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(sides, lambda s: F.concat(s["l"], s["r"])), ""))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document with its proof, folded from a tampered leaf for the ids whose crc32 is a multiple of 5."""
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = digest(*[field(ascii_lower(F.col(c)) if c == "text" else F.col(c)) for c in FIELDS])
    nodes = leaves(docs, more=[F.when(hit, other).alias("tampered")])
    folded = fold(F.coalesce("tampered", "leaf"), F.col("sides"))
    out = manifest(stage(nodes, "leaves")).select(F.col("item").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("sides")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_OP12 = """
WITH RECURSIVE field AS (
  SELECT doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ord(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM field),
tree(l, source, r, n, node) AS (
  SELECT 0, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY source), leaf FROM leaf
  UNION ALL
  SELECT l + 1, source, r // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY r)) FROM tree WHERE n > 1 GROUP BY l, source, r // 16, (n + 15) // 16),
sub AS (SELECT source, node AS subroot FROM tree WHERE n = 1),
top(l, r, n, node) AS (
  SELECT 0, row_number() OVER (ORDER BY source NULLS FIRST) - 1, count(*) OVER (), subroot FROM sub
  UNION ALL
  SELECT l + 1, r // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY r)) FROM top WHERE n > 1 GROUP BY l, r // 16, (n + 15) // 16),
places AS (
  SELECT doc_id, source, leaf, coalesce(tampered, leaf) AS claim, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM leaf),
own AS (
  SELECT 0 AS part, l, source, CAST(NULL AS BIGINT) AS s, r // 16 AS run, list(node ORDER BY r) AS nodes FROM tree WHERE n > 1 GROUP BY l, source, r // 16
  UNION ALL
  SELECT 1, l, NULL, 0, r // 16, list(node ORDER BY r) FROM top WHERE n > 1 GROUP BY l, r // 16),
climb(doc_id, source, r, n, s, part, l, claim, proof) AS (
  SELECT doc_id, source, CASE WHEN n > 1 THEN r ELSE s END, CASE WHEN n > 1 THEN n ELSE (SELECT max(n) FROM top) END, s, CASE WHEN n > 1 THEN 0 ELSE 1 END, 0, claim, '' FROM places
  UNION ALL
  SELECT c.doc_id, c.source,
    CASE WHEN c.part = 0 AND c.n <= 16 THEN c.s ELSE c.r // 16 END,
    CASE WHEN c.part = 0 AND c.n <= 16 THEN (SELECT max(n) FROM top) ELSE (c.n + 15) // 16 END, c.s,
    CASE WHEN c.part = 0 AND c.n <= 16 THEN 1 ELSE c.part END, CASE WHEN c.part = 0 AND c.n <= 16 THEN 0 ELSE c.l + 1 END,
    sha256(array_to_string(o.nodes[1:c.r % 16], '') || c.claim || array_to_string(o.nodes[c.r % 16 + 2:], '')),
    c.proof || array_to_string(o.nodes[1:c.r % 16], '') || array_to_string(o.nodes[c.r % 16 + 2:], '')
  FROM climb c JOIN own o ON o.part = c.part AND o.l = c.l AND o.run = c.r // 16 AND (c.part = 1 OR o.source IS NOT DISTINCT FROM c.source)
  WHERE c.n > 1),
done AS (SELECT doc_id, source, claim AS folded_root, sha256(proof) AS proof_sha256 FROM climb WHERE part = 1 AND n <= 1)
SELECT a.doc_id, a.leaf, b.subroot, t.node AS root, d.proof_sha256, d.folded_root, d.folded_root = t.node AS verified
FROM places a JOIN done d ON d.doc_id IS NOT DISTINCT FROM a.doc_id JOIN sub b ON b.source IS NOT DISTINCT FROM a.source JOIN top t ON t.n = 1
"""
