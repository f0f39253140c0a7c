"""Task graphs.  tasks: (task, role, state); deps: (task, dep).

Chains of tasks with one dependency and one dependent are contracted by pointer
doubling, so a long chain takes rounds by its logarithm; what is left is walked by
frontiers, in which every task and dependency counts once.  Cycles are found as strongly
connected components.  Rounds write their rows to the shared folder; the driver sees a
number or two of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filed, folder, held
from .windows import numbered


def closure(deps: DataFrame) -> DataFrame:
    """Distinct (task, dep) with all direct and indirect dependencies; cycles end as pairs repeat.

    A step follows only the pairs that the step before found; each writes its own beside
    the others', which are read as one table.
    """
    spark, at = deps.sparkSession, folder(deps.sparkSession, "closure")
    edge = filed(deps.select("task", "dep").distinct(), f"{at}/step=0")
    fresh, paths = edge, [f"{at}/step=0"]
    while not fresh.isEmpty():
        known = spark.read.schema(edge.schema).parquet(*paths)
        more = fresh.select("task", F.col("dep").alias("via")).join(edge.select(F.col("task").alias("via"), "dep"), "via").select("task", "dep").distinct()
        paths.append(f"{at}/step={len(paths)}")
        fresh = filed(more.join(known, ["task", "dep"], "left_anti"), paths[-1])
    return spark.read.schema(edge.schema).parquet(*paths)


def dependents(roots: DataFrame, deps: DataFrame) -> DataFrame:
    """(task): all tasks that depend, directly or not, on one of `roots` (task), each walked once; a root that depends on another is among them."""
    spark, at = deps.sparkSession, folder(deps.sparkSession, "dependents")
    edge = filed(deps.select("task", "dep").distinct(), f"{at}/edges")
    fresh, paths = filed(roots.select("task").distinct(), f"{at}/roots"), []
    while not fresh.isEmpty():
        more = edge.join(fresh.select(F.col("task").alias("dep")), "dep").select("task").distinct()
        if paths:
            more = more.join(spark.read.schema(fresh.schema).parquet(*paths), "task", "left_anti")
        paths.append(f"{at}/step={len(paths)}")
        fresh = filed(more, paths[-1])
    return spark.read.schema(fresh.schema).parquet(*paths) if paths else fresh


def _chains(edge: DataFrame) -> DataFrame | None:
    """(task, next, dist): tasks with one dependency and one dependent, with the first task below that isn't such and the steps to it; None if there are none.  A cycle of such tasks is an error."""
    one = edge.groupBy("task").agg(F.count("*").alias("n"), F.min("dep").alias("next")).filter("n = 1")
    link = held(one.join(edge.groupBy(F.col("dep").alias("task")).agg(F.count("*").alias("m")).filter("m = 1"), "task").select("task", "next", F.lit(1).cast("long").alias("dist")))
    n, rounds = link.count(), 0
    while n:
        ahead = link.select(F.col("task").alias("next"), F.col("next").alias("further"), F.col("dist").alias("more"))
        moved = held(link.join(ahead, "next", "left").select("task", F.coalesce("further", "next").alias("next"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("further").isNotNull().alias("moved")))
        link, rounds = moved.select("task", "next", "dist"), rounds + 1
        if not moved.agg(F.max("moved")).first()[0]:
            return link
        if 2 ** (rounds - 1) > n:
            raise ValueError("the tasks depend on one another in a cycle")
    return None


def levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task, level): the longest chain of known dependencies below a task; cycles are an error.

    Rounds grow with the depth of the graph once its chains are contracted, and with the
    logarithm of the longest of these.
    """
    names = tasks.select("task").distinct()
    edge = held(deps.join(names.select(F.col("task").alias("dep")), "dep").select("task", "dep").distinct())
    nodes = names.union(edge.select("task")).distinct()
    link = _chains(edge)
    hubs, steps = nodes, edge.select("task", F.col("dep").alias("to"), F.lit(1).cast("long").alias("w"))
    if link is not None:
        hubs = nodes.join(link, "task", "left_anti")
        beyond = link.select(F.col("task").alias("to"), "next", "dist")
        steps = steps.join(link, "task", "left_anti").join(beyond, "to", "left").select("task", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))
    steps = held(steps.groupBy("task", "to").agg(F.max("w").alias("w")))
    need = held(hubs.join(steps.groupBy("task").agg(F.count("*").alias("need")), "task", "left").select("task", F.coalesce("need", F.lit(0)).alias("need")))
    front = need.filter("need = 0").select("task", F.lit(0).cast("long").alias("level"))
    done, waiting = [front], None
    while True:
        told = steps.join(front.select(F.col("task").alias("to"), "level"), "to").groupBy("task").agg(F.count("*").alias("got"), F.max(F.col("level") + F.col("w")).alias("level"))
        if waiting is not None:
            told = waiting.union(told).groupBy("task").agg(F.sum("got").alias("got"), F.max("level").alias("level"))
        now = held(told.join(need, "task").select("task", "got", "level", (F.col("got") == F.col("need")).alias("full")))
        front, waiting = now.filter("full").select("task", "level"), now.filter("not full").select("task", "got", "level")
        if front.isEmpty():
            break
        done.append(front)
    known = held(reduce(DataFrame.union, done))
    if known.count() < need.count():
        raise ValueError("the tasks depend on one another in a cycle")
    if link is not None:
        known = known.union(link.join(known.select(F.col("task").alias("next"), "level"), "next").select("task", (F.col("level") + F.col("dist")).alias("level")))
    return known.select("task", F.col("level").cast("int").alias("level"))


def _trimmed(edge: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without some of those that begin or end at a task that nothing leads to or from: no cycle has them."""
    for _ in range(rounds):
        edge = edge.join(edge.select(F.col("dep").alias("task")).distinct(), "task", "left_semi")
        edge = held(edge.join(edge.select(F.col("task").alias("dep")).distinct(), "dep", "left_semi").select("task", "dep"))
    return edge


def _spread_least(edge: DataFrame, colour: DataFrame) -> DataFrame:
    """(task, colour): the least colour of all tasks that a task is reached from, its own included; only colours that fell are passed on."""
    fresh = colour
    while True:
        told = edge.join(fresh, "task").select(F.col("dep").alias("task"), "colour").groupBy("task").agg(F.min("colour").alias("told"))
        both = held(colour.join(told, "task", "left").select("task", F.least("colour", F.coalesce("told", "colour")).alias("colour"), (F.col("told") < F.col("colour")).alias("fell")))
        colour, fresh = both.select("task", "colour"), both.filter("fell").select("task", "colour")
        if fresh.isEmpty():
            return colour


def components(deps: DataFrame) -> DataFrame:
    """(task, component): strongly connected tasks, those that lie on cycles, with the least task of their component.

    Forward and backward colouring: every task takes the least task that reaches it;
    those of one colour that also reach its task, walked backwards within the colour,
    are a component.  The rest goes round again, and every colour yields a component a
    round.  Tasks on no cycle have no row.
    """
    edge = held(deps.select("task", "dep").filter("task is not null and dep is not null").distinct())
    found = [edge.filter("task = dep").select("task", F.col("task").alias("component"))]
    edge = edge.filter("task <> dep")
    while True:
        edge = _trimmed(edge)
        if edge.isEmpty():
            break
        nodes = edge.select("task").union(edge.select("dep")).distinct()
        colour = held(_spread_least(edge, nodes.withColumn("colour", F.col("task"))))
        inside = edge.join(colour, "task").join(colour.select(F.col("task").alias("dep"), F.col("colour").alias("other")), "dep").filter("colour = other")
        back = held(inside.select(F.col("dep").alias("task"), F.col("task").alias("dep")))
        reached = held(colour.filter("task = colour").select("task"))
        fresh = reached
        while True:
            more = held(back.join(fresh, "task").select(F.col("dep").alias("task")).distinct().join(reached, "task", "left_anti"))
            if more.isEmpty():
                break
            reached, fresh = held(reached.union(more)), more
        own = held(colour.join(reached, "task").select("task", F.col("colour").alias("component")))
        size = own.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        found.append(held(own.join(size, "component").select("task", "component")))
        edge = held(edge.join(own.select("task"), "task", "left_anti").join(own.select(F.col("task").alias("dep")), "dep", "left_anti").select("task", "dep"))
    return reduce(DataFrame.union, found).groupBy("task").agg(F.min("component").alias("component"))


def shortest_cycles(deps: DataFrame) -> DataFrame:
    """(component, path): a shortest cycle through each component's least task, in the order of its tasks; of several the least by its tasks from the end.

    A search by breadth from all components at once: a task is reached once, by the least
    task of the step before, so paths are no longer than the component and never multiply.
    """
    own = held(components(deps))
    edge = deps.select("task", "dep").distinct().join(own, "task").join(own.select(F.col("task").alias("dep"), F.col("component").alias("other")), "dep").filter("component = other")
    edge = held(edge.select("component", "task", "dep"))
    start = own.filter("task = component").select("component", "task")
    seen = held(start.select("component", "task", F.lit(None).cast(own.schema["task"].dataType).alias("before"), F.lit(0).alias("step")))
    ends, fresh, step = [], seen, 0
    while not fresh.isEmpty():
        step += 1
        told = held(edge.join(fresh.select("component", "task"), ["component", "task"]).groupBy("component", F.col("dep").alias("to")).agg(F.min("task").alias("before")))
        closed = held(told.filter("to = component").select("component", F.col("before").alias("task"), F.lit(step).alias("length")))
        ends.append(closed)
        fresh = told.join(closed.select("component"), "component", "left_anti").join(seen.select("component", F.col("task").alias("to")), ["component", "to"], "left_anti").select("component", F.col("to").alias("task"), "before", F.lit(step).alias("step"))
        for earlier in ends[:-1]:
            fresh = fresh.join(earlier.select("component"), "component", "left_anti")
        fresh = held(fresh)
        seen = held(seen.union(fresh))
    if not ends:
        return edge.select("component", F.array("task").alias("path"))
    path = reduce(DataFrame.union, ends).select("component", "task", F.array("task").alias("path"), F.col("length").alias("left"))
    out = [path.filter("left = 1")]
    path = held(path.filter("left > 1"))
    while not path.isEmpty():
        path = held(path.join(seen.select("component", "task", "before"), ["component", "task"]).select("component", F.col("before").alias("task"), F.concat(F.array("before"), "path").alias("path"), (F.col("left") - 1).alias("left")))
        out.append(path.filter("left = 1"))
        path = path.filter("left > 1")
    return reduce(DataFrame.union, out).select("component", "path")


def cycles(deps: DataFrame) -> DataFrame:
    """(start, path): all simple cycles of any length, each once, beginning with its least task.  A dense graph has exponentially many; components() and shortest_cycles() tell where cycles are."""
    edge = held(deps.select("task", "dep").distinct())
    now = edge.select(F.col("dep").alias("start"), F.col("dep").alias("last"), F.array("dep").alias("path")).distinct()
    found = [now.limit(0).select("start", "path")]
    while True:
        step = held(now.join(edge, F.col("last") == F.col("task")).filter((F.col("dep") == F.col("start")) | ((F.col("dep") > F.col("start")) & ~F.array_contains("path", F.col("dep")))))
        closed = step.filter("dep = start").select("start", "path")
        if not closed.isEmpty():
            found.append(closed)
        now = step.filter("dep > start").select("start", F.col("dep").alias("last"), F.concat("path", F.array("dep")).alias("path"))
        if now.isEmpty():
            return reduce(DataFrame.union, found)


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are completed; an unknown dependency isn't."""
    done = tasks.filter("state = 'completed'").select(F.col("task").alias("dep"))
    open_ = deps.join(done, "dep", "left_anti").select("task").distinct()
    return tasks.filter("state = 'pending'").join(open_, "task", "left_anti")


def critical_path(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task, nth) of a longest chain; in ties the least task at each step from the end.

    Which tasks lie below the last one is told by doubled steps: rounds grow with the
    logarithm of the chain.
    """
    level = held(levels(tasks, deps))
    edges = deps.join(level.select(F.col("task").alias("dep"), F.col("level").alias("below")), "dep").join(level, "task").filter("below = level - 1")
    on = held(level.orderBy(F.desc("level"), "task").limit(1).select("task", F.col("level").alias("nth")))
    jump, left, length = held(edges.groupBy("task").agg(F.min("dep").alias("dep"))), on.agg(F.max("nth")).first()[0] or 0, 1
    while length <= left:
        on = held(on.union(on.join(jump, "task").select(F.col("dep").alias("task"), F.col("nth") - length)))
        jump = held(jump.alias("a").join(jump.alias("b"), F.col("a.dep") == F.col("b.task")).select("a.task", "b.dep"))
        length *= 2
    return on


def sorted_topologically(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task, nth): by level, then by task; cycles are an error."""
    return numbered(levels(tasks, deps), "nth", F.col("level"), F.col("task")).select("task", "nth")


def unlocked(tasks: DataFrame, deps: DataFrame, completed: DataFrame) -> DataFrame:
    """Pending tasks that depend on a task of `completed` (task) and whose dependencies are all completed."""
    return ready(tasks, deps).join(deps.join(completed.select(F.col("task").alias("dep")), "dep").select("task").distinct(), "task", "left_semi")


def schedule(tasks: DataFrame, deps: DataFrame, minutes: int = 2) -> DataFrame:
    """(phase, n, minutes): the phases of a plan with an estimate of `minutes` a task; cycles are an error."""
    return levels(tasks, deps).groupBy(F.col("level").alias("phase")).agg(F.count("*").alias("n"), (F.count("*") * minutes).alias("minutes"))


def suggestions(tasks: DataFrame, deps: DataFrame, most: int = 2) -> DataFrame:
    """(type, phase, role, n): increase_parallelism if there are more phases than half the tasks; agent_scaling for a role with more than `most` tasks in a phase."""
    own = held(levels(tasks, deps).join(tasks, "task").select("task", "level", "role"))
    null = lambda t: F.lit(None).cast(t)
    deep = own.agg(F.count_distinct("level").alias("n"), F.count("*").alias("tasks")).filter("n > tasks / 2").select(F.lit("increase_parallelism").alias("type"), null("int").alias("phase"), null("string").alias("role"), "n")
    many = own.groupBy("level", "role").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit("agent_scaling"), "level", "role", "n")
    return deep.union(many)


def bottlenecks(tasks: DataFrame, deps: DataFrame, dependents: int = 3, chain: int = 5) -> DataFrame:
    """(type, task, n): high_fanout for tasks with more than `dependents` dependents, long_chain with the number of tasks of the longest chain if it has more than `chain`."""
    fan = deps.groupBy(F.col("dep").alias("task")).agg(F.count("*").alias("n")).filter(F.col("n") > dependents).select(F.lit("high_fanout").alias("type"), "task", "n")
    last = levels(tasks, deps).agg((F.max("level") + 1).cast("long").alias("n")).filter(F.col("n") > chain)
    return fan.union(last.select(F.lit("long_chain"), F.lit(None).cast(deps.schema["dep"].dataType), "n"))


#: Rows and dependencies that a stretch of phases may hold, and rounds of unlocking that it looks ahead.
STRETCH, AHEAD = 200_000, 32


def _phases(first: int, count: int):
    """For mapInArrow over one partition of (task, role, needs, open, most, deps): rows (phase, task) of up to `count` phases from `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting, kind = {}, {}, None
        for b in batches:
            kind = b.schema.field("task").type
            for task, role, needs, left, most, deps in zip(*(c.to_pylist() for c in b.columns)):
                rows[task] = [role, needs, left, most]
                for dep in deps or ():
                    waiting.setdefault(dep, []).append(task)
        if kind is None:
            return
        queues: dict = {}
        push = lambda t: heapq.heappush(queues.setdefault(rows[t][0], []), (rows[t][1], t))
        for t, (_, _, left, _) in rows.items():
            if not left:
                push(t)
        out = []
        for phase in range(first, first + count):
            now = [heapq.heappop(q)[1] for q in queues.values() for _ in range(min(len(q), rows[q[0][1]][3] if q else 0))]
            if not now:
                break
            out += [(phase, t) for t in now]
            for t in now:
                for u in waiting.get(t, ()):
                    rows[u][2] -= 1
                    if not rows[u][2]:
                        push(u)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([t for _, t in out], kind)], ["phase", "task"])

    return run


def _stretch(now: DataFrame, edge: DataFrame, first: DataFrame, count: int, at: str) -> tuple[DataFrame, int] | None:
    """What can be chosen in the next `count` phases, with its dependencies among itself, and for how many phases that is certain; None if it is too much.

    first: each role's first count * most ready tasks.  A role that has so many can't choose
    a task behind them, whatever becomes ready meanwhile; of the others those count whose
    open dependencies can all be chosen.
    """
    spark = now.sparkSession
    full = first.groupBy("role").agg(F.max("n").alias("got"), F.max("most").alias("most"), F.max(F.struct("needs", "task")).alias("last")).filter(F.col("got") >= F.col("most") * count)
    bound = filed(full.select(F.col("role").alias("of"), "last"), f"{at}/bound")
    rest = now.filter("open > 0").join(bound, F.col("role").eqNullSafe(F.col("of")), "left").filter(F.col("last").isNull() | (F.struct("needs", "task") < F.col("last")))
    columns = ["task", "role", "needs", "open", "most"]
    rest = filed(rest.select(*columns), f"{at}/rest")
    fresh, paths, told, depth = filed(first.select(*columns), f"{at}/0"), [f"{at}/0"], None, 0
    size = fresh.count()
    while depth < AHEAD:
        if size > STRETCH:
            return None
        more = edge.join(fresh.select(F.col("task").alias("dep")), "dep").join(rest.select("task"), "task", "left_semi").groupBy("task").agg(F.count("*").alias("got"))
        if told is not None:
            more = told.union(more).groupBy("task").agg(F.sum("got").alias("got"))
        now_told = filed(more.join(rest, "task"), f"{at}/told-{depth}")
        depth += 1
        paths.append(f"{at}/{depth}")
        fresh = filed(now_told.filter("got = open").select(*columns), paths[-1])
        told = now_told.filter("got < open").select("task", "got")
        if not (n := fresh.count()):
            depth = count
            break
        size += n
    chosen = spark.read.schema(fresh.schema).parquet(*paths)
    inner = filed(edge.join(chosen.select("task"), "task", "left_semi").join(chosen.select(F.col("task").alias("dep")), "dep", "left_semi"), f"{at}/inner")
    if size + inner.count() > STRETCH:
        return None
    lists = inner.groupBy("task").agg(F.collect_list("dep").alias("deps"))
    return chosen.join(lists, "task", "left").select(*columns, "deps"), min(count, depth)


def scheduled(tasks: DataFrame, deps: DataFrame, capacity: dict[str, int], default: int = 1, salts: int = 16) -> DataFrame:
    """(phase, task): phases under a limit of tasks per role: of the tasks whose dependencies are done, each role's first ones by number of dependencies, then task.

    Each phase depends on the one before, but it takes few tasks: a round ranks the ready
    tasks, each role in parts first, picks what the next phases can reach (STRETCH rows at most), and one
    task walks those phases; then open dependencies are counted down by an aggregate.
    A phase that is too large for that is a round of its own.  Ends where no progress
    is possible; a dependency on an unknown task is never done.
    """
    spark, at = tasks.sparkSession, folder(tasks.sparkSession, "phases")
    limits = F.coalesce(F.create_map(*(F.lit(x) for kv in capacity.items() for x in kv))[F.col("role")], F.lit(default)) if capacity else F.lit(default)
    edge = filed(deps.select("task", "dep").distinct(), f"{at}/edges")
    needs = edge.groupBy("task").agg(F.count("*").alias("needs"))
    first = tasks.filter("task is not null").groupBy("task").agg(F.min("role").alias("role")).join(needs, "task", "left").select("task", "role", F.coalesce("needs", F.lit(0)).alias("needs"))
    now = filed(first.select("task", "role", "needs", F.col("needs").alias("open"), limits.cast("long").alias("most")), f"{at}/now-0")
    paths, done, count, turn = [], 0, 64, 0
    order = [F.col("needs"), F.col("task")]
    while True:
        turn += 1
        part = F.pmod(F.xxhash64("task"), F.lit(salts))
        ready = now.filter("open = 0 and most > 0").withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("role", "part").orderBy(*order))).filter(F.col("n") <= F.col("most") * count)
        top = filed(ready.withColumn("n", F.row_number().over(Window.partitionBy("role").orderBy(*order))).filter(F.col("n") <= F.col("most") * count).drop("part"), f"{at}/top-{turn}")
        if top.isEmpty():
            break
        own = _stretch(now, edge, top, count, f"{at}/stretch-{turn}") if count > 1 else None
        if own is None and count > 1:
            count //= 4
            continue
        if own is None:
            chosen, walked = top.select(F.lit(done).alias("phase"), "task"), 1
        else:
            rows, walked = own
            chosen = rows.repartition(1).mapInArrow(_phases(done, walked), T.StructType([T.StructField("phase", T.IntegerType()), now.schema["task"]]))
        paths.append(f"{at}/chosen-{turn}")
        chosen = filed(chosen, paths[-1])
        done += walked
        fewer = edge.join(chosen.select(F.col("task").alias("dep")), "dep").groupBy("task").agg(F.count("*").alias("fewer"))
        now = filed(now.join(chosen.select("task"), "task", "left_anti").join(fewer, "task", "left").select("task", "role", "needs", (F.col("open") - F.coalesce("fewer", F.lit(0))).alias("open"), "most"), f"{at}/now-{turn}")
        count = min(4 * count, 1 << 14)
    if not paths:
        return tasks.select(F.lit(0).alias("phase"), "task").limit(0)
    return spark.read.schema(chosen.schema).parquet(*paths)
