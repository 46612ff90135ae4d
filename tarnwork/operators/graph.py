"""Graph queries: bounded walks, closures, resolution of virtual and macro calls.

Walks go one hop per round with an anti-join on what was visited; each round's
frontier is written to the checkpoint folder, so lineage does not grow and a
lost executor costs a reread.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .intervals import points_in_intervals

#: Parts that the callers of one class and suffix are dealt to when they learn its size.
SALTS = 32
#: Overrides of a task, about; methods held side by side; what a caller that meets a block counts for besides; tasks at most, beyond which they grow.
FAN, BLOCK, ROW, MOST_TASKS = 4_000_000, 2048, 32, 20_000


def walk(seeds: DataFrame, edges: DataFrame, depth: int, source: str = "caller", target: str = "callee") -> DataFrame:
    """seed, node, depth: nodes reached from each seed within depth hops, with their first depth; seeds at 0.

    Edges with a null target lead nowhere (see unresolved_from).
    """
    reached = written(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    frontier, steps = reached, written(edges.select(F.col(source).alias("node"), F.col(target).alias("__next")).where("node is not null and __next is not null").distinct())
    for hop in range(1, depth + 1):
        found = frontier.join(steps, "node").select("seed", F.col("__next").alias("node"), F.lit(hop).alias("depth")).distinct()
        frontier = written(found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        reached = written(reached.unionByName(frontier))
    return reached


def unresolved_from(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """seed, unresolved: calls without a known callee at nodes that a walk of this depth went on from: a forward answer is complete only at 0."""
    return edges.where("callee is null").join(reached.where(F.col("depth") < depth), F.col("caller") == F.col("node")).groupBy("seed").agg(F.count(F.lit(1)).alias("unresolved"))


def callers(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """seed, node, depth, unresolved of a reverse walk: any unresolved call of the whole index may be a caller."""
    back = walk(seeds, edges, depth, source="callee", target="caller")
    unknown = edges.agg(F.count_if(F.col("callee").isNull()).alias("unresolved"))
    return back.crossJoin(F.broadcast(unknown))


def walked_edges(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The edges that a walk of this depth took."""
    return edges.join(reached.where(F.col("depth") < depth).select("seed", F.col("node").alias("caller")), "caller").where("callee is not null")


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """source, target of the transitive closure, in as many rounds as the longest path's length has binary digits.

    After each round all pairs at most 2 ** round steps apart are known; those
    further apart by up to twice as much begin with a pair of exactly that
    distance, which the round before found.
    """
    step = written(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null").distinct())
    known = fresh = step
    while True:
        further = fresh.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        fresh = written(further.join(known, ["a", "b"], "left_anti"))
        if not fresh.limit(1).count():
            break
        known = written(known.unionByName(fresh))
    return known.select(F.col("a").alias(source), F.col("b").alias(target))


def macro_fixpoint(regions: DataFrame, expansions: DataFrame) -> DataFrame:
    """usr, round of the macros expanded in regions (path, start_line, end_line), or in the bodies of such macros.

    expansions: usr, path, line, body_path, body_start, body_end.
    """
    # places and bodies once each, whoever is expanded at them: pairs of them grow with places, not with macros
    open_ = expansions.select("path", "line").where("path is not null and line is not null").distinct()
    bodies = expansions.select("usr", F.col("body_path").alias("path"), F.col("body_start").alias("start_line"), F.col("body_end").alias("end_line")).where("path is not null").distinct()
    known, seeds = None, regions.select("path", "start_line", "end_line").distinct()
    for hop in itertools.count():
        met = written(points_in_intervals(open_, seeds, ["path"], "line", "start_line", "end_line", how="left_semi"))
        open_ = written(open_.join(met, ["path", "line"], "left_anti"))
        found = expansions.join(met, ["path", "line"], "left_semi").select("usr").distinct()
        fresh = written((found if known is None else found.join(known, "usr", "left_anti")).select("usr", F.lit(hop).alias("round")))
        if not fresh.limit(1).count():
            break
        known = fresh if known is None else written(known.unionByName(fresh))
        seeds = bodies.join(fresh, "usr").select("path", "start_line", "end_line").distinct()
    return known if known is not None else fresh


def resolve_virtual(calls: DataFrame, derived: DataFrame, methods: DataFrame) -> DataFrame:
    """calls with those to virtual methods fanned out to the overrides of derived classes, marked inferred.

    calls: caller, callee, kind; derived: base, class (closed); methods: usr,
    class, suffix (name and parameters).
    """
    below = derived.select("base", "class").distinct()
    target = methods.select(F.col("usr").alias("callee"), F.col("class").alias("base"), "suffix").join(below, "base").select("callee", "class", "suffix")
    # what a caller asks for, once, before it is fanned out: of one place in the classes, an override comes once
    asked = written(calls.where("kind = 'virtual'").join(target, "callee").select("caller", "class", "suffix").distinct())
    places = methods.join(below.select("class").distinct(), "class", "left_semi").groupBy("usr").agg(F.collect_set(F.struct("class", "suffix")).alias("p"))
    own = places.select(F.col("usr").alias("callee"), (F.size("p") > 1).alias("__many"), F.explode("p").alias("p")).select("callee", "__many", "p.*")
    # a place's methods are dealt to blocks and its callers to parts, so that a block meets a part in about FAN rows, however many there are of each
    place = ["class", "suffix"]
    sizes = asked.groupBy(*place).agg(F.count(F.lit(1)).alias("__callers")).join(own.groupBy(*place, "__many").agg(F.count(F.lit(1)).alias("__methods")), place)
    sizes = sizes.withColumn("__blocks", F.ceil(F.col("__methods") / BLOCK)).withColumn("__rows", F.col("__callers") * (F.col("__methods") + ROW * F.col("__blocks")))
    sizes = written(sizes.select(*place, "__many", "__blocks", F.ceil(F.col("__rows") / F.col("__blocks") / FAN).alias("__parts"), "__rows"))
    tasks = {r["__many"]: min(-(-r["rows"] // FAN), MOST_TASKS) for r in sizes.groupBy("__many").agg(F.sum("__rows").alias("rows")).collect()}
    # only a method that stands at several places can come twice; all others go out as they are met
    resolved = calls.withColumn("inferred", F.lit(False)).distinct()
    if False in tasks:
        resolved = resolved.unionByName(_fanned(asked, own.where("not __many"), sizes.where("not __many"), tasks[False]))
    if True in tasks:
        resolved = resolved.unionByName(_fanned(asked, own.where("__many"), sizes.where("__many"), tasks[True]).distinct())
    return resolved


def _fanned(asked: DataFrame, own: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """caller, callee, kind, inferred of each caller with all methods of the place that it asked for.

    The number of tasks is given, since it follows from the rows that come out:
    by the bytes that go in, Spark would merge them into a few.
    """
    unit = ["class", "suffix", "__block", "__part"]
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = asked.withColumn("__salt", F.pmod(F.xxhash64("caller"), F.lit(SALTS))).join(sizes.select("*", salts), ["class", "suffix", "__salt"])
    met = met.select("caller", "class", "suffix", numbers("__blocks").alias("__block"), F.pmod(F.xxhash64("caller", F.lit(1)), "__parts").alias("__part"))
    blocks = own.join(sizes, ["class", "suffix"]).groupBy("class", "suffix", "__parts", F.pmod(F.xxhash64("callee"), "__blocks").alias("__block")).agg(F.collect_list("callee").alias("callees"), F.bool_or(F.col("callee").isNull()).alias("__null"))
    # a list is collected without nulls; a method without a name is one override too
    callees = F.when(F.col("__null"), F.array_append("callees", F.lit(None))).otherwise(F.col("callees")).alias("callees")
    blocks = blocks.select("class", "suffix", "__block", numbers("__parts").alias("__part"), callees)
    pairs = met.repartition(tasks, *unit).join(blocks.repartition(tasks, *unit).hint("merge"), unit)
    return pairs.select("caller", F.explode("callees").alias("callee"), F.lit("virtual").alias("kind"), F.lit(True).alias("inferred"))


def classify_macro_calls(calls: DataFrame, expansions: DataFrame) -> DataFrame:
    """calls with direct ones that lie inside a macro's expansion (path, start_byte, end_byte) called macro."""
    direct = calls.where("kind = 'direct'")
    spans = expansions.select("path", F.col("start_byte").alias("__s"), F.col("end_byte").alias("__e"))
    # a call inside a span starts inside it: one search of points
    inside = points_in_intervals(direct.select("path", "call_id", "start_byte", "end_byte").where("start_byte <= end_byte"), spans, ["path"], "start_byte", "__s", "__e").where("end_byte <= __e")
    marked = calls.join(inside.select("call_id", F.lit(True).alias("__macro")).distinct(), "call_id", "left")
    return marked.withColumn("kind", F.when(F.col("__macro"), "macro").otherwise(F.col("kind"))).drop("__macro")


def longest_prefix(values: DataFrame, value: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """values with the longest prefix of theirs among prefixes, null without one.

    Each value is cut to the lengths that prefixes have and joined by equality.
    """
    lengths = F.broadcast(prefixes.select(F.char_length(prefix).alias("__n")).distinct())
    cut = values.select(value).distinct().join(lengths, F.char_length(value) >= F.col("__n")).withColumn(prefix, F.substring(F.col(value), F.lit(1), F.col("__n")))
    best = cut.join(prefixes.select(prefix).distinct(), prefix).groupBy(value).agg(F.max_by(prefix, F.col("__n")).alias(prefix))
    return values.join(best, value, "left")


def edge_order() -> list[Column]:
    """The order of edges in reports; an unresolved one is before the others of its caller."""
    return [F.col("caller"), F.coalesce("callee", F.lit("")), *[F.col(c) for c in ("path", "start_line", "start_byte", "end_line", "end_byte", "kind")]]


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*edge_order())
