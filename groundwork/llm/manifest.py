"""Merkle dataset manifest with octopus multiproofs.

Each row is a leaf, the hash of its columns' values. The rows of a group, in order, make a tree in which FANOUT consecutive nodes become the
hash of their digests; the groups' roots, in order, make the tree of the whole dataset. A node's coordinate is its tree, its level and its
place; the tree of groups has the number TOP.

Building: leaves are dealt by range and sorted, so that a row's place is its place in its partition and what the partitions before it hold of its group; no
group passes through one task. Each level is one grouping of at most FANOUT nodes a key, a FANOUT-th of the level below.

Proving, for all leaves or any rows of them: leaves are dealt into partitions of at most SPAN consecutive ones of one tree. Such a partition

1. computes the union of the coordinates that the proofs of its leaves need and that it can't derive from them: level by level, the
   members of its known nodes' runs that aren't known, up to the root of all;
2. fetches each of them once, by one join with the node tables;
3. derives the interior nodes that its leaves share, once each;
4. expands the proof of each leaf: the tail from any interior node upwards is made once for all leaves under it.

Defined results: rows with a null group make a group, the first one; a null place comes first; rows of the same place are ordered by digest, so
repeated rows may trade places without an effect on any digest but the proofs' own order of equal siblings. No rows: no root, no proofs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dropped, written

FANOUT = 16
#: Leaves of a partition that proofs are expanded in.
SPAN = FANOUT**3
TOP = -1


def leaf(*values: Column) -> Column:
    """The digest of values: each `-` if null, else its number of UTF-8 bytes, `:` and itself."""
    said = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in said)), 256)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df as a written table with the place of each row among those of its group (at) and their number (size)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged, name).withColumn("_p", F.shiftright("_m", 33))
    stretch = ranged.groupBy("_p", *by).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    # of a group there are as many stretches as partitions at most
    all_, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(all_).alias("size"))
    there = stretch.withColumnsRenamed({c: f"_{c}" for c in ["_p", *by]})
    on = ranged["_p"] == there["__p"]
    for c in by:
        on &= ranged[c].eqNullSafe(there[f"_{c}"])
    return ranged.join(there, on).select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("at"), "size")


@dataclass
class Manifest:
    """leaves: id, claim, tree, at, size, digest; levels: tables of tree, at, size, digest, the leaves' first; trees: tree, g (the group), digest of its root; root: of all, or None."""

    leaves: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    root: str | None

    @property
    def groups(self) -> int:
        return self.trees.count()


def _parents(nodes: DataFrame) -> DataFrame:
    run = F.sort_array(F.collect_list(F.struct("at", "digest")))  # FANOUT at most
    up = nodes.filter("size > 1").groupBy("tree", F.expr(f"at div {FANOUT}").alias("at")).agg(F.max("size").alias("size"), run.alias("run"))
    return up.select("tree", "at", F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"))


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The leaves' level and those above, up to where every tree has one node."""
    found, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        found.append(written(_parents(found[-1]), f"{name}-{len(found)}"))
        most = -(-most // FANOUT)
    return found


def build(docs: DataFrame, digest: Column, group: str = "source", order: str = "doc_id", claim: Column | None = None) -> Manifest:
    """digest: a row's leaf. claim: the leaf as whoever holds the row computes it, where it may differ."""
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("id"), digest.alias("digest"), (digest if claim is None else claim).alias("claim"))
    rows = written(rows.withColumn("claim", F.expr("nullif(claim, digest)")), "leaves")
    placed = numbered(rows, ["g"], ["id", "digest"], "placed")
    groups = placed.groupBy("g").agg(F.max("size").alias("n"))
    ranks = numbered(groups.select("g"), [], ["g"], "groups").select("g", F.col("at").alias("tree"))
    named = ranks.withColumnRenamed("g", "_g")
    leaves = written(placed.join(named, placed["g"].eqNullSafe(named["_g"])).select("id", "claim", "tree", "at", "size", "digest"), "numbered")
    dropped(rows)
    nodes = _levels(leaves.select("tree", "at", "size", "digest"), "nodes")
    tops = nodes[0].filter("size = 1")
    for level in nodes[1:]:
        tops = tops.unionByName(level.filter("size = 1"))
    trees = written(tops.select("tree", "digest").join(ranks, "tree"), "trees")
    count = trees.count()
    above = _levels(trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(count).cast("long").alias("size"), "digest"), "top")
    last = above[-1].first()
    for k, level in enumerate(above):
        nodes[k : k + 1] = [nodes[k].unionByName(level) if k < len(nodes) else level]
    return Manifest(leaves, nodes, trees, last.digest if last else None)


def _climb(places: list[int], size: int):
    """Level by level: size, and the known nodes of a tree by their parents. The last level has one node."""
    level, known = 0, sorted(set(places))
    while size > 1:
        yield level, size, known
        known, size, level = sorted({x // FANOUT for x in known}), -(-size // FANOUT), level + 1
    yield level, 1, [0]


def missing(places: list[int], size: int) -> list[tuple[int, int]]:
    """The least set of (level, place) that, with the leaves at these places, gives the root and a proof of each."""
    out = []
    for level, n, known in _climb(places, size):
        have = set(known)
        if n > 1:
            for parent in sorted({x // FANOUT for x in known}):
                out.extend((level, x) for x in range(FANOUT * parent, min(FANOUT * parent + FANOUT, n)) if x not in have)
    return out


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Tree:
    """What a partition knows of one tree: fetched nodes, derived interiors, and the tails of proofs."""

    def __init__(self, size: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.size, self.nodes = size, {(0, at): x for at, x in leaves.items()} | fetched
        sizes = []
        for level, n, known in _climb(list(leaves), size):
            sizes.append(n)
            if level:
                for x in known:
                    self.nodes[level, x] = _h("".join(self._run(level - 1, x, sizes[-2])))
        self.sizes, self.top = sizes, len(sizes) - 1
        self._tails: dict[tuple[int, int], str] = {}

    def _run(self, level: int, parent: int, n: int) -> list[str]:
        return [self.nodes[level, x] for x in range(FANOUT * parent, min(FANOUT * parent + FANOUT, n))]

    def sides(self, level: int, at: int) -> tuple[str, str]:
        """The siblings before and after a node."""
        run = self._run(level, at // FANOUT, self.sizes[level])
        return "".join(run[: at % FANOUT]), "".join(run[at % FANOUT + 1 :])

    def proof(self, level: int, at: int) -> str:
        """All siblings from a node to the root; kept for interior nodes, which leaves share."""
        if level == self.top:
            return ""
        if (level, at) in self._tails:
            return self._tails[level, at]
        out = "".join(self.sides(level, at)) + self.proof(level + 1, at // FANOUT)
        if level:
            self._tails[level, at] = out
        return out

    def fold(self, at: int, digest: str) -> str:
        for level in range(self.top):
            left, right = self.sides(level, at)
            digest, at = _h(left + digest + right), at // FANOUT
        return digest


_ASKED = "tree long, part long, node_tree long, level int, at long"
_PROVED = "id long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string"
_KINDS = {"id": pa.int64()}


def _proved(rows: dict[str, list]) -> pa.Table:
    names = [x.split()[0] for x in _PROVED.split(", ")]
    return pa.table({c: pa.array(rows.get(c, []), _KINDS.get(c, pa.string())) for c in names})


def _asker(groups: int):
    def ask(leaves: pa.Table) -> pa.Table:
        tree, part = leaves["tree"][0].as_py(), leaves["part"][0].as_py()
        found = [(tree, *x) for x in missing(leaves["at"].to_pylist(), leaves["size"][0].as_py())] + [(TOP, *x) for x in missing([tree], groups)]
        n = len(found)
        where, level, at = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"tree": pa.array([tree] * n, pa.int64()), "part": pa.array([part] * n, pa.int64()), "node_tree": pa.array(where, pa.int64()), "level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64())})

    return ask


def _expander(groups: int, whole: bool):
    def expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        if not len(leaves):
            return _proved({})
        rows, nodes = leaves.to_pydict(), fetched.to_pydict()
        own, above = {}, {}
        for where, level, at, digest in zip(nodes["node_tree"], nodes["level"], nodes["at"], nodes["digest"], strict=True):
            (above if where == TOP else own)[level, at] = digest
        tree_at = rows["tree"][0]
        tree = _Tree(rows["size"][0], dict(zip(rows["at"], rows["digest"], strict=True)), own)
        subroot = tree.nodes[tree.top, 0]
        top = _Tree(groups, {tree_at: subroot}, above)
        root, tail = top.nodes[top.top, 0], top.proof(0, tree_at)
        out = {c: [] for c in ("id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root")}
        for id_, at, digest, claim in zip(rows["id"], rows["at"], rows["digest"], rows["claim"], strict=True):
            proof = tree.proof(0, at) + tail
            folded = top.fold(tree_at, tree.fold(at, claim or digest))
            for c, x in zip(out, (id_, digest, subroot, root, proof if whole else None, _h(proof), folded), strict=True):
                out[c].append(x)
        return _proved(out)

    return expand


def prove(manifest: Manifest, rows: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof (all siblings, with `whole`), proof_sha256, folded_root (from the claim, else the leaf), verified, for the leaves of a
    manifest or, of them, `rows` (columns of its leaves)."""
    groups = manifest.groups
    leaves = (manifest.leaves if rows is None else rows).withColumn("part", F.expr(f"at div {SPAN}"))
    asked = written(leaves.select("tree", "part", "at", "size").groupBy("tree", "part").applyInArrow(_asker(groups), _ASKED), "asked")
    needed = [r.level for r in asked.select("level").distinct().collect()]  # levels, a logarithm of the rows
    fetched = asked.join(_nodes(manifest, needed), ["node_tree", "level", "at"]).select("tree", "part", "node_tree", "level", "at", "digest")
    out = leaves.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(_expander(groups, whole), _PROVED)
    return out.withColumn("verified", F.col("folded_root") == F.lit(manifest.root))


def _nodes(manifest: Manifest, levels: list[int]) -> DataFrame:
    """The node tables of some levels, with columns of their own: with all leaves at hand, none of the lowest is asked for."""
    out = None
    for k in levels or [0]:
        level = manifest.levels[k].select(F.col("tree").alias("node_tree"), F.lit(k).alias("level"), F.col("at").alias("at"), F.col("digest").alias("digest"))
        out = level if out is None else out.unionByName(level)
    return out
