"""Conflicting interval assertions and the choice of a heaviest consistent set of them."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, nlargest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sorted_join, staged
from .graph import components

# where the search of all other components would be the longer way: vertices; vertices; cut vertices; vertices of a two-colourable component
ENUMERATE, FOREST, CUTSET, FLOW = 16, 256, 4, 2048
STATES, CHECKED, WITNESSES = 20_000, 32, 8  # states at once before a component is branched; degree up to which neighbours are compared; states that others are compared with
WIDTH, SPAN = 24, 64  # units of time to a bucket; buckets of a short interval


def conflict_edges(assertions: DataFrame) -> DataFrame:
    """a, b (ids, a < b) of assertions on one subject, predicate and scope whose half-open intervals overlap and that differ in
    object with positive polarity, or in polarity on one object. A null start or end is unbounded.

    assertions: id, subject, predicate, object, scope, polarity (1 or -1), start, end. Intervals meet in buckets of WIDTH, and a pair
    counts in the first bucket that both are in, so that a subject with many assertions over time is no all-pairs join.
    Intervals of more than SPAN buckets, or without an end, are long; these are joined by subject with all others.
    """
    keys = ["subject", "predicate", "scope"]
    low, high = F.lit(-(2**62)).cast("bigint"), F.lit(2**62).cast("bigint")
    x = assertions.select(*keys, "id", "object", "polarity", F.coalesce("start", low).alias("s"), F.coalesce("end", high).alias("e")).where("s < e")
    first, last = F.floor(F.col("s") / WIDTH), F.floor((F.col("e") - 1) / WIDTH)
    x = x.withColumns({"f": first, "long": last - first >= SPAN}).withColumn("l", F.when(~F.col("long"), last))
    rename = lambda df: df.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("id", "object", "polarity", "s", "e", "f", "long")], *[c for c in df.columns if c == "bucket"])
    short = x.where("not long").withColumn("bucket", F.explode(F.sequence("f", "l")))
    near = short.join(sorted_join(rename(short)), [*keys, "bucket"]).where((F.col("bucket") == F.greatest("f", "f2")) & (F.col("id") < F.col("id2")))
    far = x.where("long").join(sorted_join(rename(x)), keys).where((F.col("id") != F.col("id2")) & (~F.col("long2") | (F.col("id") < F.col("id2"))))
    columns = ["id", "id2", "object", "object2", "polarity", "polarity2", "s", "s2", "e", "e2"]
    met = near.select(*columns).unionByName(far.select(*columns)).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
    clash = F.when(F.col("object") == F.col("object2"), F.col("polarity") != F.col("polarity2")).otherwise((F.col("polarity") == 1) & (F.col("polarity2") == 1))
    return met.where(clash).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def _forest(nodes: list, weight: dict, near: dict) -> list:
    """Heaviest independent set of a forest, by dynamic programming from the leaves."""
    seen, chosen = set(), []
    for root in nodes:
        if root in seen:
            continue
        order, parent, stack = [], {root: None}, [root]
        while stack:
            v = stack.pop()
            seen.add(v)
            order.append(v)
            for u in near[v]:
                if u not in parent:
                    parent[u] = v
                    stack.append(u)
        take, skip = {}, {}
        for v in reversed(order):
            kids = [u for u in near[v] if parent.get(u) == v]
            take[v] = weight[v] + sum(skip[u] for u in kids)
            skip[v] = sum(max(take[u], skip[u]) for u in kids)
        use = {}
        for v in order:
            use[v] = not use.get(parent[v], False) and take[v] > skip[v]
        chosen += [v for v in order if use[v]]
    return chosen


def colored(nodes: list, near: dict) -> dict | None:
    """A two-colouring, or None where there is an odd cycle."""
    color: dict = {}
    for root in nodes:
        if root in color:
            continue
        color[root], queue = 0, [root]
        for v in queue:
            for u in near[v]:
                if u not in color:
                    color[u] = 1 - color[v]
                    queue.append(u)
                elif color[u] == color[v]:
                    return None
    return color


def min_cut(nodes: list, weight: dict, near: dict, color: dict) -> tuple[list, int]:
    """(heaviest independent set, greatest flow) of a two-coloured graph: the flow runs from the source through vertices of
    colour 0, bounded by their weights, over the edges to those of colour 1 and the sink; what the cut leaves is independent,
    and weighs the total less the flow. Shortest augmenting paths, all of one length in a phase."""
    flow: dict = {v: {} for v in nodes}  # over edges from colour 0
    left = {v: weight[v] for v in nodes}  # what source or sink can still take
    ahead = {v: sorted(near[v]) for v in nodes}
    total = 0
    while True:
        level = {v: 0 for v in nodes if color[v] == 0 and left[v] > 0}
        queue, found = list(level), False
        for v in queue:
            for u in near[v]:
                if u not in level and (color[v] == 0 or flow[u].get(v, 0) > 0):
                    level[u] = level[v] + 1
                    queue.append(u)
                    found |= color[u] == 1 and left[u] > 0
        if not found:
            break
        turn = dict.fromkeys(level, 0)  # an arc that leads nowhere does so for the whole phase
        for root in [v for v in nodes if level.get(v) == 0 and color[v] == 0]:
            while left[root] > 0:
                path, v = [root], root
                while not (color[v] == 1 and left[v] > 0):
                    if turn[v] == len(ahead[v]):
                        path.pop()
                        if not path:
                            break
                        v = path[-1]
                        turn[v] += 1
                        continue
                    u = ahead[v][turn[v]]
                    if level.get(u) == level[v] + 1 and (color[v] == 0 or flow[u].get(v, 0) > 0):
                        path.append(u)
                        v = u
                    else:
                        turn[v] += 1
                if not path:
                    break
                amount = min(left[root], left[v], *[flow[b][a] for a, b in zip(path, path[1:], strict=False) if color[a] == 1])
                for a, b in zip(path, path[1:], strict=False):
                    if color[a] == 0:
                        flow[a][b] = flow[a].get(b, 0) + amount
                    else:
                        flow[b][a] -= amount
                left[root] -= amount
                left[v] -= amount
                total += amount
    return sorted(v for v in nodes if (v in level) == (color[v] == 0)), total


def _reduced(weight: dict, near: dict) -> tuple[list, dict]:
    """(taken, what is left of near): some heaviest set holds the taken vertices and a heaviest set of those left. A vertex is
    taken if it weighs as much as its neighbours together, and dropped if it weighs nothing or has a neighbour that is as heavy
    and in conflict with no other vertex than it is."""
    live, taken = {v: set(n) for v, n in near.items()}, []
    queue = sorted(live, reverse=True)
    waiting = set(queue)

    def drop(v) -> None:
        for u in live.pop(v):
            live[u].discard(v)
            if u not in waiting:
                waiting.add(u)
                queue.append(u)

    while queue:
        v = queue.pop()
        waiting.discard(v)
        if v not in live:
            continue
        if weight[v] <= 0:
            drop(v)
        elif weight[v] >= sum(weight[u] for u in live[v]):
            taken.append(v)
            for u in list(live[v]):
                drop(u)
            drop(v)
        elif len(live[v]) <= CHECKED:
            for u in sorted(live[v]):
                if weight[u] <= weight[v] and len(live[u]) >= len(live[v]) and all(x == u or x in live[u] for x in live[v]):
                    drop(u)
    return taken, live


def _swept(near: dict) -> list:
    """The vertices in an order in which few are begun: next is a neighbour of the former ones that brings in the fewest others."""
    order, unseen, done, heap = [], {v: len(n) for v, n in near.items()}, set(), []
    seen: set = set()

    def see(v) -> None:
        if v not in seen:
            seen.add(v)
            for u in near[v]:
                unseen[u] -= 1
                if u in seen and u not in done:
                    heappush(heap, (unseen[u], u))
            heappush(heap, (unseen[v], v))

    for root in sorted(near, key=lambda v: (len(near[v]), v)):
        see(root)
        while heap:
            n, v = heappop(heap)
            if v in done or n != unseen[v]:
                continue
            done.add(v)
            order.append(v)
            for u in sorted(near[v]):
                see(u)
    return order


def _by_states(weight: dict, near: dict, rank: dict | None = None) -> list | None:
    """Heaviest independent set by the vertices in turn: a state is the set of later vertices that the chosen ones forbid. A state
    is left out if another one is heavier by all that can be chosen of what it forbids in addition (one vertex of a clique at
    most). None if there are more than STATES at once."""
    order = sorted(near, key=lambda v: rank[v]) if rank else _swept(near)
    at = {v: i for i, v in enumerate(order)}
    clique: dict = {}  # a division of the vertices into cliques
    sizes: list = []
    for v in order:
        met: dict = {}
        for u in near[v]:
            if u in clique:
                met[clique[u]] = met.get(clique[u], 0) + 1
        whole = [c for c, n in met.items() if n == sizes[c]]
        clique[v] = max(whole, key=lambda c: (sizes[c], c)) if whole else len(sizes)
        if whole:
            sizes[clique[v]] += 1
        else:
            sizes.append(1)
    states: dict = {0: (0, None)}
    for i, v in enumerate(order):
        later = 0
        for u in near[v]:
            if at[u] > i:
                later |= 1 << (at[u] - i - 1)
        new: dict = {}
        for mask, (total, chosen) in states.items():
            rest = mask >> 1
            if rest not in new or new[rest][0] < total:
                new[rest] = (total, chosen)
            if not mask & 1:
                rest, more = rest | later, total + weight[v]
                if rest not in new or new[rest][0] < more:
                    new[rest] = (more, (v, chosen))
        best = nlargest(WITNESSES, new.items(), key=lambda x: x[1][0])
        states = {}
        for mask, (total, chosen) in new.items():
            for other, (most, _) in best:
                if most < total or other == mask:
                    continue
                spare, extra, tops = most - total, other & ~mask, {}
                while extra and spare >= 0:
                    bit = extra & -extra
                    u = order[i + bit.bit_length()]
                    c, w = clique[u], weight[u]
                    if w > (top := tops.get(c, 0)):
                        spare -= w - top
                        tops[c] = w
                    extra ^= bit
                if spare >= 0:
                    break
            else:
                states[mask] = (total, chosen)
        if len(states) > STATES:
            return None
    out, chosen = [], states[0][1]
    while chosen:
        out.append(chosen[0])
        chosen = chosen[1]
    return out


def _search(weight: dict, near: dict, rank: dict | None = None) -> list:
    """Heaviest independent set of any graph: reduced, each part by itself by a least cut or by states; where these are too many,
    the better of the two ways with and without the vertex of most conflicts. The time has no bound but all sets."""
    out, live = _reduced(weight, near)
    twins: dict = {}  # those of equal conflicts are one vertex, as heavy as all of them
    for v, n in live.items():
        twins.setdefault(frozenset(n), []).append(v)
    if len(twins) < len(live):
        same = {vs[0]: vs for vs in twins.values()}
        fewer = {v: {u for u in live[v] if u in same} for v in same}
        return out + [u for v in _search({v: sum(weight[u] for u in vs) for v, vs in same.items()}, fewer, rank) for u in same[v]]
    seen: set = set()
    for root in live:
        if root in seen:
            continue
        part = [root]
        seen.add(root)
        for v in part:
            for u in live[v]:
                if u not in seen:
                    seen.add(u)
                    part.append(u)
        sub = {v: live[v] for v in sorted(part)}
        if (color := colored(list(sub), sub)) is not None:
            out += min_cut(list(sub), weight, sub, color)[0]
            continue
        got = _by_states(weight, sub, rank)
        if got is None:
            pivot = max(sub, key=lambda v: (len(sub[v]), weight[v]))
            without = lambda gone: {v: n - gone for v, n in sub.items() if v not in gone}  # noqa: B023, E731
            ways = [_search(weight, without({pivot}), rank), [pivot, *_search(weight, without({pivot} | sub[pivot]), rank)]]
            got = max(ways, key=lambda x: sum(weight[v] for v in x))
        out += got
    return out


def _cut_set(nodes: list, weight: dict, near: dict) -> tuple[list, int] | None:
    """(heaviest independent set, cut vertices) by all choices among up to CUTSET vertices whose removal leaves a forest; None if
    these are not enough."""
    cut, live = [], {v: set(n) for v, n in near.items()}

    def cyclic() -> list:
        degree = {v: len(n) for v, n in live.items()}
        queue = [v for v, d in degree.items() if d <= 1]
        gone = set()
        while queue:
            v = queue.pop()
            if v in gone:
                continue
            gone.add(v)
            for u in live[v]:
                if u not in gone:
                    degree[u] -= 1
                    if degree[u] <= 1:
                        queue.append(u)
        return [v for v in live if v not in gone]

    while core := cyclic():
        if len(cut) == CUTSET:
            return None
        v = max(sorted(core), key=lambda x: len(live[x]))
        cut.append(v)
        for u in live.pop(v):
            live[u].discard(v)
    best = (-1, [])
    for mask in range(1 << len(cut)):
        inside = [v for i, v in enumerate(cut) if mask >> i & 1]
        if any(b in near[a] for a in inside for b in inside):
            continue
        banned = set().union(*[near[v] for v in inside]) if inside else set()
        rest = [v for v in live if v not in banned]
        sub = {v: live[v] - banned for v in rest}
        got = inside + _forest(sorted(rest), weight, sub)
        total = sum(weight[v] for v in got)
        if total > best[0]:
            best = (total, sorted(got))
    return best[1], len(cut)


def solve(weight: dict, edges: list[tuple], rank: dict | None = None) -> tuple[list, str]:
    """(chosen ids, state) of one component, always a heaviest set: enumeration up to 16 vertices (of equally heavy sets the
    lexicographically least), a least cut up to 2,048 where two colours suffice, up to 256 a cut set of up to 4 vertices whose
    removal leaves a forest; anything else is searched, in the order of rank if that is given (intervals by their starts: few are
    open at once)."""
    nodes = sorted(weight)
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    if len(nodes) <= ENUMERATE:
        best = (0, ())

        def grow(i: int, got: tuple, total: int, banned: frozenset) -> None:
            nonlocal best
            if total > best[0] or total == best[0] and got and (not best[1] or got < best[1]):
                best = (total, got)
            for j in range(i, len(nodes)):
                if nodes[j] not in banned:
                    grow(j + 1, (*got, nodes[j]), total + weight[nodes[j]], banned | near[nodes[j]])

        grow(0, (), 0, frozenset())
        return list(best[1]), "exact: enumeration"
    if len(nodes) <= FLOW and (color := colored(nodes, near)) is not None:
        return min_cut(nodes, weight, near, color)[0], "exact: flow"
    if len(nodes) <= FOREST and (found := _cut_set(nodes, weight, near)) is not None:
        return found[0], "exact: cut set" if found[1] else "exact: forest"
    return sorted(_search(weight, near, rank)), "exact: search"


def resolve(assertions: DataFrame) -> DataFrame:
    """id, component, chosen, state: a heaviest conflict-free set of each component of the conflict graph.

    Assertions without conflict are chosen. The rows of a component reach one task in the order of their starts, and that task holds
    one component at a time, of any size. assertions also has `weight` (at least 0).
    """
    edges = conflict_edges(assertions)
    comps = components(edges, "a", "b").withColumnRenamed("node", "id").withColumnRenamed("root", "component")
    placed = assertions.select("id", "weight", "start").join(sorted_join(comps), "id", "left")
    alone = placed.where("component is null").select("id", F.col("id").alias("component"), F.lit(True).alias("chosen"), F.lit("exact: alone").alias("state"))
    out_edges = edges.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("near"))
    rows = placed.where("component is not null").join(sorted_join(out_edges), "id", "left")
    rows = rows.repartition("component").sortWithinPartitions("component", "start", "id").select("component", "id", "weight", "near")
    kind = assertions.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, weight, near = None, {}, []

        def solved() -> list[tuple]:
            chosen, state = solve(weight, near, {v: i for i, v in enumerate(weight)})
            got = set(chosen)
            return [(v, at, v in got, state) for v in weight]

        columns = ["id", "component", "chosen", "state"]
        for batch in batches:
            out = []
            for c, v, w, vs in zip(*[batch[x].tolist() for x in ("component", "id", "weight", "near")], strict=True):
                if c != at:
                    out += solved() if weight else []
                    at, weight, near = c, {}, []
                weight[v] = int(w)
                near += [(v, u) for u in vs.tolist()] if vs is not None else []
            yield pd.DataFrame(out, columns=columns)
        if weight:
            yield pd.DataFrame(solved(), columns=columns)

    solved = rows.mapInPandas(run, f"id {kind}, component {kind}, chosen boolean, state string")
    return alone.unionByName(solved)


def certificate(assertions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Checks a resolution relationally: rows, chosen, chosen weight, and the conflicts left among chosen ones (must be 0)."""
    chosen = resolved.where("chosen").select("id")
    bad = conflict_edges(assertions).join(chosen.withColumnRenamed("id", "a"), "a").join(chosen.withColumnRenamed("id", "b"), "b")
    total = resolved.join(assertions.select("id", "weight"), "id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("chosen"), 1)).alias("chosen"), F.sum(F.when(F.col("chosen"), F.col("weight")).otherwise(0)).alias("weight"))
    return total.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("conflicts"))))


def component_digests(assertions: DataFrame, resolved: DataFrame) -> DataFrame:
    """component, state_hash: an order-free digest of each component's vertices and weights."""
    h = F.xxhash64("id", "weight")
    rows = resolved.select("id", "component").join(sorted_join(assertions.select("id", "weight")), "id")
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("y"))


def resolve_changed(assertions: DataFrame, changed: DataFrame, former: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolution, re-solved components) after `changed` (id, weight) replaced weights: components whose digest is as before keep
    their rows of `former`; only the others are solved again. Weights don't change who conflicts with whom."""
    new = assertions.join(sorted_join(changed.select("id", F.col("weight").alias("_w"))), "id", "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")
    before, after = component_digests(assertions, former), component_digests(new, former)
    touched = staged(after.join(sorted_join(before), ["component", "size", "x", "y"], "left_anti").select("component"), "touched")
    rows = former.select("id", "component").join(sorted_join(touched), "component")
    again = resolve(staged(new.join(sorted_join(rows.select("id")), "id", "left_semi"), "again"))  # read several times
    return former.join(sorted_join(touched), "component", "left_anti").unionByName(again), touched
