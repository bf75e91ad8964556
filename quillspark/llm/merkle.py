"""Merkle manifest of documents by nested-interval labels.

A leaf is a row's digest; within its tree (language) it has a rank, and every node above carries the interval of leaf ranks
[lo, hi) that it covers.  Levels are built in bands of ``BAND``: the nodes of a band's lowest level fall, by their intervals, into
level buckets of at most 2 ** BAND nodes, a bucket is one row, and its levels are arrays.  A bucket's root is a node of the next
band.  Ancestors are attached by a join that looks for the node of the band above that contains a bucket's interval; its equality
is on tree and level bucket, so it never meets more than one.  Within a parent, what its interval has more than the node's is
the interval of the node's sibling, which stands in the same level at that interval's bucket; where nothing is left, there is
none.

Subroots are the leaves of one more tree, so any number of languages will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ranks import ranked
from quillspark.llm.shared import materialize

#: Levels of a band.
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row's fields, each by its length and value, or ``-`` if null."""
    return F.sha2(F.concat(*(_field(columns[name]) for name in FIELDS)), 256)


def _node(level: Column, at: Column) -> Column:
    """Node ``at`` of the level above ``level``: its interval, and the digest of its one or two children."""
    left, right = F.get(level, 2 * at), F.get(level, 2 * at + 1)
    digest = F.sha2(F.concat(left["digest"], F.coalesce(right["digest"], F.lit(""))), 256)
    return F.struct(left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"), digest.alias("digest"))


def _level_above(level: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda at: _node(level, at))


def _step(below: Column, above: Column, at: Column, start: Column, level: int, shift: int) -> Column:
    """The sibling of node ``at >> level``: the difference between its parent's interval and its own."""
    own, parent = F.get(below, F.shiftright(at, level)), F.get(above, F.shiftright(at, level + 1))
    left = parent["lo"] < own["lo"]
    lo = F.when(left, parent["lo"]).when(own["hi"] < parent["hi"], own["hi"])
    return F.struct(F.coalesce(left, F.lit(False)).alias("left"), F.get(below, F.shiftright(lo - start, shift + level).cast("int"))["digest"].alias("digest"))


def band_of(nodes: DataFrame, shift: int) -> DataFrame:
    """``tree, bucket, lo, hi, digest, units`` of the buckets into which ``nodes`` (tree, lo, hi, digest, payload) of level
    ``shift`` fall; ``units`` has each node's payload, digest and ``path``, its siblings and those of its ancestors in the band."""
    rows = nodes.withColumn("bucket", F.shiftright("lo", shift + BAND))
    rows = rows.groupBy("tree", "bucket").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "payload"))).alias("nodes"))
    size = F.size("nodes")
    # a lone bucket ends with its root; where there are others, even one node is carried up through all levels
    short = (F.col("bucket") == 0) & (size < 1 << BAND)
    rows = rows.withColumn("height", F.when(short, F.ceil(F.log2(size.cast("double"))).cast("int")).otherwise(BAND))
    rows = rows.withColumn("level0", F.transform("nodes", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))))
    for k in range(BAND):  # columns of their own, as they would else be worked out anew for each element
        level = F.col(f"level{k}")
        above = _level_above(level)
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("height") > k, above).otherwise(level))
    rows = rows.withColumn("start", F.shiftleft("bucket", shift + BAND))

    def unit(x: Column, at: Column) -> Column:
        steps = F.array(*(_step(F.col(f"level{k}"), F.col(f"level{k + 1}"), at, F.col("start"), k, shift) for k in range(BAND)))
        return F.struct(x["payload"].alias("payload"), x["lo"].alias("lo"), x["digest"].alias("digest"), F.slice(steps, F.lit(1), F.col("height")).alias("path"))

    root = F.get(f"level{BAND}", F.lit(0))
    return rows.select("tree", "bucket", root["lo"].alias("lo"), root["hi"].alias("hi"), root["digest"].alias("digest"), F.transform("nodes", unit).alias("units"))


def bands_of(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The bands of all trees over ``leaves`` (tree, rank, digest, payload); the last has one bucket for each tree."""
    nodes = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "payload")
    bands = []
    while True:
        bands.append(materialize(band_of(nodes, BAND * len(bands)), f"{name}-band"))
        if not (bands[-1].agg(F.max("bucket").alias("b")).first()["b"] or 0):
            return bands
        nodes = bands[-1].select("tree", "lo", "hi", "digest", F.lit(0).alias("payload"))


def proofs(bands: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """``payload, digest, path, subroot, root`` of every leaf.  ``top`` has ``tree, path, root`` of the trees' own roots."""
    roots = bands[-1].withColumn("subroot", F.col("digest"))
    if top is None:
        held = roots.select("*", F.array().cast("array<struct<left:boolean,digest:string>>").alias("upper"), F.col("digest").alias("root"))
    else:
        top = top.select(F.col("tree").alias("of"), F.col("path").alias("upper"), "root")
        held = roots.join(top, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    for k in range(len(bands) - 1, 0, -1):
        node = held.select("tree", "subroot", "root", "upper", F.explode("units").alias("unit"))
        node = node.select(F.col("tree").alias("of"), "subroot", "root", F.col("unit.lo").alias("from"), F.shiftright("unit.lo", BAND * k).alias("level_bucket"), F.concat("unit.path", "upper").alias("upper"))
        below = bands[k - 1].withColumn("own_bucket", F.shiftright("lo", BAND * k))
        contains = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("from") + (1 << BAND * k))
        held = below.join(node, F.col("tree").eqNullSafe(F.col("of")) & (F.col("own_bucket") == F.col("level_bucket")) & contains)
        held = held.select("tree", "units", "subroot", "root", "upper")
    leaves = held.select("subroot", "root", "upper", F.explode("units").alias("unit"))
    return leaves.select("unit.payload", "unit.digest", F.concat("unit.path", "upper").alias("path"), "subroot", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.when(s["left"], F.concat(s["digest"], d)).otherwise(F.concat(d, F.coalesce(s["digest"], F.lit("")))), 256))


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The bands of the documents' trees, one for each language, and those of the tree over their roots."""
    columns = {name: F.col(name) for name in FIELDS}
    changed = columns | {"n_chars": (F.col("n_chars").cast("decimal(38,0)") + 1)}
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", leaf(columns).alias("digest"), F.when(chosen, leaf(changed)).alias("tampered"))
    leaves = ranked(materialize(leaves, "merkle-leaves"), "tree", ["doc_id", "digest"], "merkle")
    bands = bands_of(leaves.select("tree", "rank", "digest", F.struct("doc_id", "tampered").alias("payload")), "merkle")
    subroots = bands[-1].select(F.lit("").alias("all"), F.col("tree").alias("lang"), "digest")
    subroots = ranked(materialize(subroots, "merkle-subroots"), "all", ["lang"], "merkle-top")
    return bands, bands_of(subroots.select(F.col("all").alias("tree"), "rank", "digest", F.struct("lang").alias("payload")), "merkle-top")


def verify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A null field is written ``-``, so an empty text and a null one give different leaves; a null language is a tree of its
    own and comes first; a null id comes first in its tree and is not tampered with.  Rows with equal ids go by their leaves;
    equal rows are leaves side by side.  Long texts are digested whole.  Other columns are not read; an empty table gives no
    rows.
    """
    bands, tops = manifest(docs)
    top = materialize(proofs(tops).select(F.col("payload.lang").alias("tree"), "path", "root"), "merkle-paths")
    found = proofs(bands, top).select("payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "payload.tampered")
    siblings = F.transform("path", lambda s: F.coalesce(s["digest"], F.lit("")))
    found = found.withColumns({"proof_sha256": F.sha2(F.array_join(siblings, ""), 256), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_sql_field(n_chars if name == 'n_chars' else name) for name in FIELDS)})"


_WALK = """
  UNION ALL
  SELECT w.tree, w.leaf_no, w.j // 2, w.level + 1, w.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN w.j % 2 = 1 THEN s.digest || w.fold ELSE w.fold || coalesce(s.digest, '') END)
  FROM {walk} w JOIN {nodes} m ON m.tree IS NOT DISTINCT FROM w.tree AND m.level = w.level AND m.j = w.j AND m.n > 1
       LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM w.tree AND s.level = w.level AND s.j = xor(w.j, 1)"""
_NODES = """
  UNION ALL
  SELECT tree, level + 1, j // 2, sha256(string_agg(digest, '' ORDER BY j)), (any_value(n) + 1) // 2
  FROM {nodes} WHERE n > 1 GROUP BY tree, level, j // 2"""
#: crc32 of the id's decimal text: for each byte a step that takes it in, and eight that shift.
_CRC = "xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
ORACLE = f"""
WITH RECURSIVE
d AS (SELECT lang AS tree, doc_id, {_sql_leaf('n_chars')} AS leaf,
             CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS leaf_no FROM d),
nodes AS (SELECT tree, 0 AS level, leaf_no AS j, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves {_NODES.format(nodes='nodes')}),
subroots AS (SELECT tree AS lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS lang_no FROM nodes WHERE n = 1),
top_nodes AS (SELECT '' AS tree, 0 AS level, lang_no AS j, subroot AS digest, count(*) OVER () AS n FROM subroots {_NODES.format(nodes='top_nodes')}),
top AS (SELECT level AS top_height, digest AS root FROM top_nodes WHERE n = 1),
walk AS (SELECT tree, leaf_no, leaf_no AS j, 0 AS level, '' AS proof, coalesce(tampered, leaf) AS fold FROM leaves {_WALK.format(walk='walk', nodes='nodes')}),
ended AS (SELECT w.*, s.lang_no, s.subroot FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.tree AND s.height = w.level),
numbered AS (SELECT *, row_number() OVER () AS e FROM ended),
top_walk AS (SELECT '' AS tree, e AS leaf_no, lang_no AS j, 0 AS level, proof, fold FROM numbered {_WALK.format(walk='top_walk', nodes='top_nodes')})
SELECT l.doc_id, l.leaf, e.subroot, t.root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = t.root AS verified
FROM top_walk w JOIN top t ON w.level = t.top_height JOIN numbered e ON e.e = w.leaf_no
     JOIN leaves l ON l.tree IS NOT DISTINCT FROM e.tree AND l.leaf_no = e.leaf_no
"""
