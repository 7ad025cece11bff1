"""A Merkle manifest of a dataset, verified by a recursive query that climbs from each leaf.

Every row is a leaf, the hash of its fields. The leaves of a source, in the order of their
ids, are hashed three by three, and so are the results, until one node, the *subroot*, is
left; the subroots, in the order of their sources, are hashed likewise up to the root.

1. A range sort numbers the leaves over all tasks. The parent of a node at place p of its
   level is at place p div 3 of the next, so a level is one grouping by that place. Each
   built level is written; a third of the rows go on to the next one.
2. The stored levels become parent-linked node rows: (id, parent, slot, kids), where kids
   are the digests of the node's run, 32 bytes each, and slot is its place in its parent's.
3. A recursive query (``WITH RECURSIVE``) starts with every leaf, joins its node row, emits
   the other digests of the run as siblings, folds the leaf's own digest with them, and goes
   on with the node's parent until there is none. Both the given and the tampered leaf are
   single digests, so each row climbs with the one to verify.
4. The emitted siblings of a leaf, at most two a level, are put in the order of the levels
   and hashed to its proof; the last fold is the folded root.

Sources of any size are split over all tasks: places come from the sort, levels are grouped
by place, and a source is looked up by broadcast only if it has more than a thousandth of
the rows. The climb has as many rounds as the two trees have levels (about 3 log of the
rows), which Spark limits to ``spark.sql.cteRecursionLevelLimit`` (100 by default).

Defined cases: a null field is ``-``; rows without a source form the first source; null ids
come before others; rows with equal ids are ordered by their leaf; a row without an id is
never tampered with; repeated rows are leaves of their own; empty and very long texts are
hashed whole; other columns, whatever their names, are not read; a single leaf is its own
subroot, a single subroot the root; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeforge.llm.frames import join_by_share
from themeforge.operators.ordering import row_positions
from themeforge.session import stage

ARITY = 3
DIGEST = 32
#: Places of a level are numbered below this; more rows than 2^56 are out of reach.
LEVEL_BITS = 56
#: Levels of the tree over the sources are numbered from here.
UPPER = 64


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _field(value: Column) -> Column:
    """The UTF-8 byte count, a colon and the value; a dash for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields as lowercase hex."""
    return _sha(F.concat(*map(_field, fields)))


def _node_id(level: Column | int, place: Column) -> Column:
    level = F.lit(level).cast("bigint") if isinstance(level, int) else level.cast("bigint")
    return F.shiftleft(level, LEVEL_BITS) + place


def _levels(base: DataFrame, most: int) -> list[DataFrame]:
    """The built levels over ``base``: (tree, n, place, digest) -> (tree, n, place, kids, digest).

    A tree is a run of ``n`` nodes; ``most`` is the largest n.
    """
    out, below = [], base
    while most > 1:
        most = -(-most // ARITY)
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda s: s["digest"])
        grouped = below.filter("n > 1").groupBy(
            "tree", F.ceil(F.col("n") / ARITY).cast("bigint").alias("n"), F.expr(f"place div {ARITY}").alias("place")
        ).agg(run.alias("run"))
        kids = F.concat(*[F.coalesce(F.get("run", F.lit(k)), F.lit(b"")) for k in range(ARITY)])
        built = grouped.select("tree", "n", "place", kids.alias("kids")).withColumn(
            "digest", F.unhex(_sha(_hex(F.col("kids"))))
        )
        below = stage(built, "merkle-level")
        out.append(below)
    return out


def _linked(level: int, frame: DataFrame) -> DataFrame:
    """A level's rows with their node id, and the parent of those that have one in their tree."""
    at = F.col("tree") + F.col("place")
    up = F.col("tree") + F.expr(f"place div {ARITY}")
    return frame.withColumns({
        "id": _node_id(level, at), "parent": F.when(F.col("n") > 1, _node_id(level + 1, up)),
        "slot": (F.col("place") % ARITY).cast("int"),
    })


CLIMB = """
WITH RECURSIVE climb (leaf, node, slot, level, fold, siblings) AS (
    SELECT leaf, parent, slot, 0, fold, X'' FROM {leaves}
    UNION ALL
    SELECT c.leaf, n.parent, n.slot, c.level + 1,
        unhex(sha2(CAST(lower(hex(concat(
            substring(n.kids, 1, c.slot * 32), c.fold, substring(n.kids, c.slot * 32 + 33)))) AS BINARY), 256)),
        concat(substring(n.kids, 1, c.slot * 32), substring(n.kids, c.slot * 32 + 33))
    FROM climb c JOIN {nodes} n ON c.node = n.id)
SELECT leaf, level, siblings, IF(node IS NULL, fold, NULL) AS fold FROM climb"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf, siblings, folded) of each leaf: its siblings' digests from below, and its folded root.

    ``leaves``: (leaf, parent, slot, fold); ``nodes``: (id, parent, slot, kids).
    """
    spark = leaves.sparkSession
    names = {"leaves": "merkle_leaves", "nodes": "merkle_nodes"}
    leaves.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    # Spark ends a recursion after a million rows unless it is told that there may be more.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        steps = stage(spark.sql(CLIMB.format(**names)), "merkle-climb")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
        for name in names.values():
            spark.catalog.dropTempView(name)
    ordered = F.array_sort(F.collect_list(F.struct("level", "siblings")))
    return steps.groupBy("leaf").agg(
        F.aggregate(ordered, F.lit(b""), lambda all, s: F.concat(all, s["siblings"])).alias("siblings"),
        F.max("fold").alias("folded"),
    )


def manifest(
    docs: DataFrame, fields: list[str], tampered: dict[str, Column], id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``tampered`` gives columns as they are found when the manifest is checked.
    """
    given = [F.col(c) for c in fields]
    found = [tampered.get(c, F.col(c)) for c in fields]
    rows = docs.select(
        F.col(id).alias("key"), F.col(source).cast("string").alias("source"),
        F.unhex(leaf_hash(given)).alias("digest"), F.unhex(leaf_hash(found)).alias("fold"),
    )
    # Global places in the order of (source, id, leaf); a source is a run of them.
    placed = row_positions(rows, ["source", "key", "digest", "fold"], "leaf").withColumns(
        {"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}
    )
    on = ["none", "name"]
    runs = placed.groupBy(*on).agg(F.min("leaf").alias("tree"), F.count("*").alias("n"))
    sources = stage(row_positions(runs, ["tree"], "at"), "merkle-sources")
    sizes = sources.agg(F.sum("n").alias("rows"), F.count("*").alias("sources"), F.max("n").alias("most")).first()
    known = sources.select(*on, "tree", "n", F.col("n").alias("share"))
    base = stage(
        join_by_share(placed, known, on, "share", sizes["rows"] or 0).select(
            "key", "leaf", "digest", "fold", "tree", "n", (F.col("leaf") - F.col("tree")).alias("place")
        ),
        "merkle-leaves",
    )
    levels = [_linked(0, base.withColumn("kids", F.lit(None).cast("binary")))]
    levels += [_linked(k, f) for k, f in enumerate(_levels(base, sizes["most"] or 0), 1)]

    # The top of each source is a leaf of the tree over the sources.
    every = sizes["sources"]
    tops = None
    for frame in levels:
        top = frame.filter("n = 1").select("tree", "digest")
        tops = top if tops is None else tops.unionByName(top)
    subroots = stage(
        tops.join(sources.select("tree", F.col("at").alias("place")), "tree").select(
            F.col("tree").alias("of"), F.lit(0).cast("bigint").alias("tree"), F.lit(every).cast("bigint").alias("n"),
            "place", "digest",
        ),
        "merkle-subroots",
    )
    upper = [_linked(UPPER + k, f) for k, f in enumerate(_levels(subroots.drop("of"), every), 1)]
    over = _linked(UPPER, subroots).select(
        F.col("of").alias("tree"), F.col("parent").alias("top_parent"), F.col("slot").alias("top_slot")
    )

    def with_parents(frame: DataFrame) -> DataFrame:
        """Subroots get their parent in the tree over the sources."""
        inner = frame.filter("n > 1")
        top = frame.filter("n = 1").join(over, "tree").withColumns({"parent": F.col("top_parent"), "slot": F.col("top_slot")})
        return inner.unionByName(top.select(inner.columns))

    linked = ["id", "parent", "slot", "kids"]
    stored = None
    for frame in [with_parents(f) for f in levels[1:]] + upper:
        part = frame.select(linked)
        stored = part if stored is None else stored.unionByName(part)
    leaves = with_parents(levels[0]).select("leaf", "parent", "slot", "fold")
    if stored is None:
        stored = levels[0].filter("false").select(linked)
    proofs = climb(stage(leaves, "merkle-starts"), stage(stored, "merkle-nodes"))

    root = (upper[-1] if upper else subroots).select(_hex(F.col("digest")).alias("root")).first()
    heads = subroots.select(F.col("of").alias("tree"), _hex(F.col("digest")).alias("subroot"))
    shares = heads.join(sources.select("tree", F.col("n").alias("share")), "tree")
    shown = join_by_share(base.select("key", "leaf", "digest", "tree"), shares, ["tree"], "share", sizes["rows"] or 0)
    folded = _hex(F.col("folded"))
    known_root = F.lit(root["root"] if root else None).cast("string")
    return shown.join(proofs, "leaf").select(
        F.col("key").alias(id), _hex(F.col("digest")).alias("leaf"), "subroot", known_root.alias("root"),
        _sha(_hex(F.col("siblings"))).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == known_root).alias("verified"),
    )
