"""Kinds of records, induced from the fields that they share, and the nulls that each kind has to beat.

Records of equal fields are one class, so the work follows the different profiles and not the records. Classes are compared once for each pair with a common
field, in blocks; average-linkage clusters grow in rounds, in which all pairs of clusters that are each other's nearest merge at once (for average
linkage that gives the clusters of merging the best pair first). Nulls are draws as rows: random subsets by exact ranks of random
numbers, and populations whose fields were traded between records with all margins kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.store import dropped, written

#: Records that trade fields in one task; classes of a field that are compared with each other in one block; rows that one task ranks.
GROUP, BLOCK, RANKED = 2048, 1024, 4096
#: Classes of a population that one task clusters at most.
HERE = 1500
#: Steps of likeness by which nulls are counted.
STEPS = 1024
#: Deals of the records into new groups, where they are more than one group.
ROUNDS = 4


def admitted_profiles(records: DataFrame, min_share: float) -> DataFrame:
    """id, profile: of each record (id, fields), sorted, the fields that at least min_share of all records have. There are at most mean fields / min_share."""
    own = records.select("id", F.array_distinct(F.coalesce("fields", F.array().cast("array<string>"))).alias("fields"))
    total = own.agg(F.count("*").alias("total"))  # one row
    n = own.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    kept = n.filter(F.col("n") >= F.col("total") * min_share).agg(F.collect_set("field").alias("kept"))  # one row
    return own.crossJoin(F.broadcast(kept)).select("id", F.sort_array(F.array_intersect("fields", "kept")).alias("profile"))


def chance(seed: Column, id: Column) -> Column:
    """A number in [0, 1) of a record in a draw."""
    return F.pmod(F.xxhash64(seed, id), F.lit(1 << 52)) / F.lit(float(1 << 52))


# --- trading fields


def _pass(held: np.ndarray, rng: np.random.Generator) -> None:
    """Deals the rows into pairs; each pair's fields that only one of them has are dealt anew, as many to each as before."""
    half = len(held) // 2
    order = rng.permutation(len(held))
    a, b = order[:half], order[half : 2 * half]
    left, right = held[a], held[b]
    either, both = left ^ right, left & right
    keys = np.where(either, rng.random(either.shape), 2.0)
    first = keys.argsort(axis=1).argsort(axis=1) < (left & ~right).sum(axis=1)[:, None]
    held[a], held[b] = both | (either & first), both | (either & ~first)


def _trader(seed: int, turn: int, turns: int):
    def trade(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        lists = table["profile"].combine_chunks()
        size = np.asarray(lists.value_lengths())
        fields, which = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        held = np.zeros((len(table), len(fields)), dtype=bool)
        held[np.repeat(np.arange(len(table)), size), which] = True
        rng = np.random.default_rng([seed, turn, *(x.as_py() for x in key)])
        for _ in range(-(-10 * int(size.sum()) // (len(table) * turns)) if len(table) > 1 else 0):  # five trades for each field held
            _pass(held, rng)
        row, col = np.nonzero(held)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(table)))]).astype(np.int32)
        return pa.table({"r": table["r"], "id": table["id"], "profile": pa.ListArray.from_arrays(offsets, pa.array(fields[col], pa.string()))})

    return trade


def field_swaps(profiles: DataFrame, reseeds: int, seed: int) -> DataFrame:
    """r, id, profile: `reseeds` populations in which fields were traded between records at random, so that each record keeps its number of fields and
    each field its number of records. Records without a field have nothing to trade and are left out.

    Records are dealt into groups of about GROUP, which trade among themselves, several times anew where there are several groups.
    """
    kept = profiles.filter(F.size("profile") > 0)
    groups = kept.count() // GROUP + 1
    turns = ROUNDS if groups > 1 else 1
    out = kept.select(F.explode(F.sequence(F.lit(0), F.lit(reseeds - 1))).alias("r"), "id", "profile")
    ddl = f"r int, id {profiles.schema['id'].dataType.simpleString()}, profile array<string>"
    for turn in range(turns):
        dealt = F.floor(chance(F.lit(seed) + F.col("r") * 7919 + turn * 104_729, F.col("id")) * groups).cast("int")
        out = out.groupBy("r", dealt.alias("dealt")).applyInArrow(_trader(seed, turn, turns), ddl)
    return out


# --- classes and their likeness


def classes_of(profiles: DataFrame) -> DataFrame:
    """r, name (least id), profile, n: records of one profile."""
    return profiles.filter(F.size("profile") > 0).groupBy("r", "profile").agg(F.min("id").alias("name"), F.count("*").alias("n"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """r, a, b (a < b), j: the Jaccard likeness of each two classes with a common field, once: where the first common field meets them.

    The classes of a field are dealt into blocks of about BLOCK; two blocks meet under a key of their own, so a field that all have is no single group.
    """
    each = classes.select("r", "name", "profile", F.explode("profile").alias("field"))
    wide = each.groupBy("r", "field").agg(F.count("*").alias("k")).withColumn("blocks", (F.col("k") / BLOCK).cast("int") + 1).drop("k")
    dealt = each.join(wide, ["r", "field"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    left = dealt.select("r", "field", F.col("own").alias("lo"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("hi"), F.col("name").alias("x"), F.col("profile").alias("p"))
    right = dealt.select("r", "field", F.explode(F.expr("sequence(0, own)")).alias("lo"), F.col("own").alias("hi"), F.col("name").alias("y"), F.col("profile").alias("q"))
    met = left.join(right, ["r", "field", "lo", "hi"]).filter("if(lo = hi, x < y, true)").withColumn("c", F.array_intersect("p", "q")).filter("c[0] = field")
    j = F.size("c") / (F.size("p") + F.size("q") - F.size("c"))
    return met.select("r", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), j.alias("j"))


# --- nulls by random subsets


def ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """rows (id, u) with the rank of u, from 1, in each group of `by`, ties by id; n: rows of a group. No task ranks more than about RANKED rows."""
    buckets = n // RANKED + 1
    dealt = rows.withColumn("bucket", F.floor(F.col("u") * buckets))
    own = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("u", "id"))
    if buckets == 1:
        return dealt.withColumn("rank", own).drop("bucket")
    counts = dealt.groupBy(*by, "bucket").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(counts.select(*by, "bucket", before.alias("before")), [*by, "bucket"]).withColumn("rank", own + F.col("before")).drop("bucket", "before")


def _sums(batches):
    """Sums over class pairs of likeness times the members drawn of both."""
    found: dict[tuple, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        j = batch["j"].to_numpy(zero_copy_only=False)
        x, y = (np.stack(batch[c].to_numpy(zero_copy_only=False)) for c in ("x", "y"))
        keys = list(zip(batch["r"].to_pylist(), batch["label"].to_pylist(), strict=True))
        order: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            order.setdefault(k, []).append(i)
        for k, at in order.items():
            found[k] = found.get(k, 0) + (j[at, None] * x[at] * y[at]).sum(axis=0)
    rows = [(r, label, d, float(v)) for (r, label), s in found.items() for d, v in enumerate(s)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.float64()), strict=True)], ["r", "label", "draw", "s"])


def drawn_cohesion(drawn: DataFrame, pairs: DataFrame, draws: int) -> DataFrame:
    """r, label, draw, mean: mean likeness of all pairs of the records drawn. drawn: r, label, draw, name (the class), a row a record."""
    n = drawn.groupBy("r", "label", "draw", "name").agg(F.count("*").alias("k"))
    own = n.groupBy("r", "label", "draw").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("s"), F.sum("k").alias("m"))
    filled = F.expr(f"transform(sequence(0, {draws - 1}), d -> double(coalesce(said[d], 0)))")
    rows = n.groupBy("r", "label", "name").agg(F.map_from_entries(F.collect_list(F.struct("draw", "k"))).alias("said")).select("r", "label", "name", filled.alias("k"))
    x, y = rows.select("r", "label", F.col("name").alias("a"), F.col("k").alias("x")), rows.select("r", "label", F.col("name").alias("b"), F.col("k").alias("y"))
    met = pairs.join(x, ["r", "a"]).join(y, ["r", "label", "b"]).select("r", "label", "j", "x", "y")
    across = met.mapInArrow(_sums, "r int, label string, draw int, s double").groupBy("r", "label", "draw").agg(F.sum("s").alias("t"))
    mean = F.round((F.col("s") + F.coalesce("t", F.lit(0.0))) / (F.col("m") * (F.col("m") - 1) / 2), 12)
    return own.join(across, ["r", "label", "draw"], "left").filter("m > 1").select("r", "label", "draw", mean.alias("mean"))


def _draws(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    u = chance(F.lit(seed) + F.col("r") * 104_729 + F.col("draw") * 7919, F.col("id"))
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", u)


def halves(rows: DataFrame, by: list[str], n: int, k: int) -> DataFrame:
    """The k rows (id, u) of least u, ties by id, of each group of `by`; n: rows of a group.

    Counts by steps of u tell the step in which the k-th lies; only the rows of that one are ranked.
    """
    buckets = n // RANKED + 1
    dealt = rows.withColumn("bucket", F.floor(F.col("u") * buckets))
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "bucket").agg(F.count("*").alias("in")).withColumn("before", F.coalesce(F.sum("in").over(order), F.lit(0)))
    cut = counts.filter((F.col("before") < k) & (F.col("before") + F.col("in") >= k)).select(*by, F.col("bucket").alias("cut"), (F.lit(k) - F.col("before")).alias("rest"))
    placed = dealt.join(F.broadcast(cut), by)  # a row a group, of which there are draws times populations
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("u", "id"))
    last = placed.filter("bucket = cut").withColumn("rank", rank).filter("rank <= rest").select(*rows.columns)
    return placed.filter("bucket < cut").select(*rows.columns).unionByName(last)


def cohesion_thresholds(members: DataFrame, pairs: DataFrame, n: int, draws: int, quantile: float, seed: int) -> DataFrame:
    """r, threshold: the quantile of the mean likeness in random halves of the population. No row where all draws agree, or of fewer than 3 records.

    members: r, id, name; n: records of a population."""
    half = halves(_draws(members, draws, seed), ["r", "draw"], n, max(2, n // 2)).withColumn("label", F.lit(""))
    means = drawn_cohesion(half, pairs, draws)
    out = means.groupBy("r").agg(F.expr(f"percentile(mean, {quantile}D)").alias("threshold"), F.min("mean").alias("low"), F.max("mean").alias("high"))
    return out.filter("low < high").filter(F.lit(n >= 3)).select("r", "threshold")


def null_placement(observed: DataFrame, samples: DataFrame, on: list[str]) -> DataFrame:
    """observed (on, x) with p, the samples (on, s) at or above x by one more than all, null without samples or where all agree."""
    met = observed.join(samples, on, "left")
    keys = [F.col(c) for c in observed.columns]
    got = met.groupBy(*keys).agg(F.sum((F.col("s") >= F.col("x")).cast("long")).alias("k"), F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    return got.withColumn("p", F.when(F.col("low") < F.col("high"), F.col("k") / (F.col("n") + 1))).drop("k", "n", "low", "high")


def shared_placement(observed: DataFrame, samples: DataFrame) -> DataFrame:
    """observed (x) with p as in null_placement, all against the same samples (s), both from 0 to 1: those of higher steps are counted, those of x's own step compared."""
    step = lambda c: F.floor(F.col(c) * STEPS).cast("int")
    values = samples.groupBy("s").agg(F.count("*").alias("k")).withColumn("step", step("s"))
    counts = values.groupBy("step").agg(F.sum("k").alias("in"))
    every = samples.sparkSession.range(STEPS + 1).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left")
    higher = every.select("step", F.coalesce(F.sum("in").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("higher"))
    whole = samples.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))  # one row
    keys = [F.col(c) for c in observed.columns]
    met = observed.withColumn("step", step("x")).join(higher, "step").join(values, "step", "left").groupBy(*keys, "higher")
    got = met.agg(F.sum(F.when(F.col("s") >= F.col("x"), F.col("k")).otherwise(0)).alias("same")).crossJoin(F.broadcast(whole))
    return got.withColumn("p", F.when(F.col("low") < F.col("high"), (F.col("higher") + F.col("same")) / (F.col("n") + 1))).drop("higher", "same", "n", "low", "high")


# --- clusters


def _merges(a: np.ndarray, b: np.ndarray, s: np.ndarray, size: np.ndarray, threshold: float, names: list[str]) -> np.ndarray:
    """The cluster (its least class) of each class: the best pair merges first. a, b: numbers of classes; s: likeness summed over all pairs of their records."""
    n, size = len(names), size.astype(float)
    sums = np.zeros((n, n))
    sums[a, b] = sums[b, a] = s
    mean = np.round(sums / np.outer(size, size), 12)
    np.fill_diagonal(mean, -1)
    into, best = np.arange(n), mean.max(axis=1, initial=-1)
    while n and (top := best.max()) >= threshold and top > -1:
        pairs = [(x, int(y)) for x in np.flatnonzero(best == top).tolist() for y in np.flatnonzero(mean[x] == top) if x < y]
        x, y = max(pairs, key=lambda p: (zlib.crc32(f"{names[p[0]]}|{names[p[1]]}".encode()), p))
        sums[x] += sums[y]
        sums[:, x] = sums[x]
        size[x] += size[y]
        into[into == y] = x
        mean[y] = mean[:, y] = -1
        live = mean[x] >= 0
        mean[x] = np.where(live, np.round(sums[x] / (size[x] * size), 12), -1)
        mean[:, x] = mean[x]
        best = mean.max(axis=1)
    return into


def _merge_here(table: pa.Table) -> pa.Table:
    both = pa.chunked_array([*table["a"].chunks, *table["b"].chunks], table["a"].type)
    n = np.concatenate([table["na"].to_numpy(), table["nb"].to_numpy()])
    names = both.unique().take(pc.sort_indices(both.unique()))
    at = pc.index_in(both, names).to_numpy()
    size = np.empty(len(names))
    size[at] = n
    into = _merges(at[: len(table)], at[len(table) :], table["s"].to_numpy(), size, table["threshold"][0].as_py(), [str(x) for x in names.to_pylist()])
    moved = np.flatnonzero(into != np.arange(len(into)))
    return pa.table({"r": pa.array(np.full(len(moved), table["r"][0].as_py(), np.int32)), "name": names.take(pa.array(moved)), "cluster": names.take(pa.array(into[moved]))})


def agglomerate(classes: DataFrame, pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """r, name, cluster (its least class): average linkage down to the threshold of r.

    In a round, each cluster looks for its nearest one, by mean likeness over all pairs of records, then by a hash of both names; pairs that
    chose each other merge; a round is some Spark jobs, writes its edges as a table and removes the one before. A population of up to HERE classes is
    clustered in one task, the best pair first. Both give the same clusters where no two likenesses are equal; of equal ones the hash decides, whose
    order among later merges may differ.
    """
    size = classes.select("r", "name", "n")
    edges = pairs.join(size.withColumnsRenamed({"name": "a", "n": "na"}), ["r", "a"]).join(size.withColumnsRenamed({"name": "b", "n": "nb"}), ["r", "b"])
    edges = written(edges.join(F.broadcast(thresholds), "r").select("r", "a", "b", (F.col("j") * F.col("na") * F.col("nb")).alias("s"), "na", "nb", "threshold"), "edges")
    many = [x.r for x in classes.groupBy("r").count().filter(F.col("count") > HERE).collect()]  # numbers of populations
    kind = classes.schema["name"].dataType.simpleString()
    into = edges.filter(~F.col("r").isin(many)).groupBy("r").applyInArrow(_merge_here, f"r int, name {kind}, cluster {kind}")
    if many:
        into = into.unionByName(_merge_rounds(edges.filter(F.col("r").isin(many))))
    own = classes.join(F.broadcast(thresholds), "r", "left_semi").select("r", "name")
    return own.join(into, ["r", "name"], "left").select("r", "name", F.coalesce("cluster", "name").alias("cluster"))


def _merge_rounds(edges: DataFrame) -> DataFrame:
    """r, name, cluster of the classes that have merged, by rounds."""
    members = last = None
    while True:
        tie = F.crc32(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))
        worth = edges.withColumn("w", F.struct(F.round(F.col("s") / (F.col("na") * F.col("nb")), 12).alias("mean"), tie.alias("tie"), "a", "b"))
        near = worth.filter("w.mean >= threshold").select("r", "w", F.explode(F.array("a", "b")).alias("x")).groupBy("r", "x").agg(F.max("w").alias("best"))
        chosen = near.groupBy("r", "best").agg(F.count("*").alias("k")).filter("k = 2").select("r", F.col("best.a").alias("into"), F.col("best.b").alias("gone"))
        chosen = written(chosen.join(edges.select("r", F.col("a").alias("into"), F.col("b").alias("gone"), (F.col("na") + F.col("nb")).alias("joint")), ["r", "into", "gone"]), "chosen")
        if chosen.isEmpty():
            return members if members is not None else chosen.select("r", F.col("gone").alias("name"), F.col("into").alias("cluster"))
        new = chosen.select("r", F.col("gone").alias("name"), F.col("into").alias("cluster"))
        if members is not None:
            moved = members.join(chosen.select("r", F.col("gone").alias("cluster"), "into"), ["r", "cluster"], "left")
            new = new.unionByName(moved.select("r", "name", F.coalesce("into", "cluster").alias("cluster")))
        members = written(new, "members")
        # of both clusters of a merger: where it goes, and how many records it has then
        fate = chosen.select("r", F.explode(F.array("into", "gone")).alias("x"), F.col("into").alias("to"), "joint")
        for c in ("a", "b"):
            edges = edges.join(fate.withColumnRenamed("x", c), ["r", c], "left").withColumn(f"n{c}", F.coalesce("joint", f"n{c}")).withColumn(c, F.coalesce("to", c)).drop("to", "joint")
        edges = edges.filter("a <> b").select("r", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb"), "threshold")
        before, edges = last, written(edges.groupBy("r", "a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("threshold").alias("threshold")), "edges")
        last = edges
        if before is not None:
            dropped(before)


def cluster_cohesion(classes: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """r, cluster, size, cohesion: mean likeness of all pairs of its records, null of one record."""
    own = members.join(classes, ["r", "name"]).groupBy("r", "cluster").agg(F.sum("n").alias("size"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"))
    side = lambda c: members.join(classes, ["r", "name"]).select("r", F.col("name").alias(c), F.col("cluster").alias(f"c{c}"), F.col("n").alias(f"n{c}"))
    met = pairs.join(side("a"), ["r", "a"]).join(side("b"), ["r", "b"]).filter("ca = cb")
    across = met.groupBy("r", F.col("ca").alias("cluster")).agg(F.sum(F.col("j") * F.col("na") * F.col("nb")).alias("t"))
    mean = F.when(F.col("size") > 1, F.round((F.col("s") + F.coalesce("t", F.lit(0.0))) / (F.col("size") * (F.col("size") - 1) / 2), 12))
    return own.join(across, ["r", "cluster"], "left").select("r", "cluster", "size", mean.alias("cohesion"))


# --- kinds


def induce_kinds(records: DataFrame, min_share: float, min_size: int, draws: int, quantile: float, reseeds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(kinds, members) of records (id, fields), one row a record.

    kinds: kind (its least id), size, cohesion, core (the field most of it has, of equal ones that of most records), core_share, existence_p (against random
    subsets of its size), search_p (against all clusters that the same search finds in populations with traded fields; null where that
    null has no spread), constraint_p (the core's share, against random subsets of all records), height: above if existence and constraint pass,
    peer if neither does, else unstable, also where a null has no spread; ground: eva-only where trading fields changes no profile. A cluster is a kind if it has
    min_size records, passes existence, and passes the search at a quantile shared among all such clusters. members: id, kind.
    No kinds: of fewer than 3 records with an admitted field, or where all random halves are alike.
    """
    profiles = written(admitted_profiles(records, min_share), "profiles")
    held = profiles.filter(F.size("profile") > 0)
    n = held.count()
    swaps = written(field_swaps(profiles, reseeds, seed), "swaps")
    every = held.select(F.lit(-1).alias("r"), "id", "profile").unionByName(swaps)
    classes = written(classes_of(every), "classes")
    pairs = written(class_pairs(classes), "pairs")
    named = written(every.join(classes.select("r", "profile", "name"), ["r", "profile"]).select("r", "id", "name"), "named")
    thresholds = written(cohesion_thresholds(named, pairs, n, draws, quantile, seed), "thresholds")
    members = written(agglomerate(classes, pairs, thresholds), "members")
    found = written(cluster_cohesion(classes, members, pairs).filter(F.col("size") >= max(2, min_size)), "found")
    real = written(found.filter("r = -1").select(F.col("cluster").alias("kind"), "size", F.col("cohesion").alias("x")), "real")
    candidates = real.count()
    of = written(named.filter("r = -1").join(members.filter("r = -1").select("name", F.col("cluster").alias("kind")), "name").join(real.select("kind"), "kind", "left_semi").select("id", "kind"), "of")

    # the population is dealt at random to the clusters' sizes: each gets a random subset of its own size
    place = of.withColumn("r", F.lit(-1)).withColumn("u", chance(F.lit(seed + 3), F.col("id")))
    place = ranked(place, ["r"], n).select("rank", F.col("kind").cast("string").alias("label"))
    drawn = ranked(_draws(named.filter("r = -1"), draws, seed + 1), ["r", "draw"], n).join(place, "rank")
    existence = drawn_cohesion(drawn, pairs, draws).select(F.col("label"), F.col("mean").alias("s"))
    real = null_placement(real.withColumn("label", F.col("kind").cast("string")), existence, ["label"]).withColumnRenamed("p", "existence_p")

    moved = _moved(classes)
    search = found.filter("r >= 0").select(F.col("cohesion").alias("s")) if moved else found.filter("false").select(F.col("cohesion").alias("s"))
    real = shared_placement(real, search).withColumnsRenamed({"p": "search_p", "x": "cohesion"})
    passed = lambda p, q: F.col(p) <= 1 - q + 1e-9
    family = 1 - (1 - quantile) / max(candidates, 1)
    real = written(real.filter(passed("existence_p", quantile)).filter(F.col("search_p").isNull() | passed("search_p", family)), "real")

    in_kind = of.join(profiles, "id").select("kind", F.explode("profile").alias("field")).groupBy("kind", "field").agg(F.count("*").alias("k"))
    over_all = profiles.select(F.explode("profile").alias("field")).groupBy("field").agg(F.count("*").alias("all"))
    share = in_kind.join(over_all, "field").join(real.select("kind", "size"), "kind").withColumn("share", F.col("k") / F.col("size")).filter(F.col("share") >= min_share)
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("share"), F.desc("all"), "field"))
    core = share.withColumn("first", first).filter("first = 1").select("kind", F.col("field").alias("core"), F.col("share").alias("core_share"))
    everyone = profiles.count()
    sub = ranked(_draws(profiles.withColumn("r", F.lit(-1)), draws, seed + 2), ["r", "draw"], everyone)
    sub = sub.join(place.join(core.withColumn("label", F.col("kind").cast("string")), "label"), "rank")
    shares = sub.groupBy("label", "draw").agg(F.round(F.avg(F.array_contains("profile", F.col("core")).cast("double")), 12).alias("s")).select("label", "s")
    out = real.join(core, "kind", "left").withColumn("x", F.round("core_share", 12))
    out = null_placement(out, shares, ["label"]).withColumnRenamed("p", "constraint_p")
    e, c = passed("existence_p", quantile), passed("constraint_p", quantile)
    height = F.when(F.col("existence_p").isNull() | F.col("constraint_p").isNull(), "unstable").when(e & c, "above").when(~e & ~c, "peer").otherwise("unstable")
    kinds = out.select("kind", "size", "cohesion", "core", "core_share", "existence_p", "search_p", "constraint_p", height.alias("height"), F.lit("key" if moved else "eva-only").alias("ground"))
    return kinds, of.join(real.select("kind"), "kind", "left_semi")


def _moved(classes: DataFrame) -> bool:
    """Whether trading changed how many records have each profile, in any population."""
    real = classes.filter("r = -1").select("profile", F.col("n").alias("real"))
    alike = classes.filter("r >= 0").join(real, "profile", "left").filter(F.col("real").isNull() | (F.col("real") != F.col("n")))
    return not alike.isEmpty()
