"""Co-review graphs: construction, label propagation, components, betweenness, modularity and Girvan-Newman communities."""

from __future__ import annotations

from collections import defaultdict, deque
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.shared import discard, written
from oremill.operators.pairs import shared_groups

#: Relative tolerance within which betweenness values are tied.
TIE = 1e-9


def co_review_graph(pairs: DataFrame, threshold: int, left: str = "user_id", right: str = "business_id") -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): edges (src, dst), src < dst, between users with at least `threshold` distinct businesses each and in common;
    vertices (id) are the ends of edges. Repeated pairs and nulls change nothing."""
    distinct = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    enough = distinct.groupBy(left).agg(F.count("*").alias("_k")).where(F.col("_k") >= threshold).select(left)
    kept = distinct.join(enough, left, "left_semi")
    edges = written(shared_groups(kept, left, right, threshold).select(F.col("left").alias("src"), F.col("right").alias("dst")), "edges")
    return edges, edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree)."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after synchronous rounds, in each of which every vertex takes the most frequent label among its neighbours; ties go to the
    smallest. The labels of a round are written, so that the plan stays short."""
    both = symmetric(edges)
    labels = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label"))
    before = None
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        # The most votes, then the smallest label: an aggregate, which combines before the shuffle.
        best = votes.groupBy("id").agg(F.max("n").alias("n"))
        labels = written(votes.join(best, ["id", "n"]).groupBy("id").agg(F.min("label").alias("label")), "labels")
        discard(before)
        before = labels
    return labels


def connected_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, community): the smallest id that is reachable. Vertices without edges are communities of their own.

    Each round takes the least label around every vertex and jumps to that label's own label; it ends when nothing changes.
    """
    both = written(symmetric(edges), "edges")
    labels = vertices.select("id", F.col("id").alias("label")).distinct()
    before = None
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(around, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        labels = written(least.join(jump, "label", "left").select("id", F.least("label", "far").alias("label"), "old"), "labels")
        discard(before)
        before = labels
        if labels.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("community"))
        path = labels._oremill_path
        labels = labels.select("id", "label")
        labels._oremill_path = path
    raise RuntimeError("no fixpoint was reached")


# Betweenness ----------------------------------------------------------------------------------------------------------


def _brandes(around: dict[str, list[str]], roots: list[str]) -> dict[tuple[str, str], float]:
    """Halved sums of the edges' shares in the shortest paths from the roots."""
    total: dict[tuple[str, str], float] = defaultdict(float)
    for root in roots:
        level, paths = {root: 0}, defaultdict(int, {root: 1})
        order, queue = [], deque([root])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in around[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in around[w]:
                if level[v] == level[w] - 1:
                    share = credit[w] * paths[v] / paths[w]
                    credit[v] += share
                    total[(v, w) if v < w else (w, v)] += share / 2
    return total


def _neighbours(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    around: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    return {v: sorted(n) for v, n in around.items()}


def _with_component(edges: DataFrame) -> DataFrame:
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = connected_components(vertices, edges)
    return edges.join(parts.select(F.col("id").alias("src"), "community"), "src").select("community", "src", "dst")


def edge_betweenness(edges: DataFrame, most_local: int = 50_000) -> DataFrame:
    """(src, dst, value): number of shortest paths over each edge, summed over all pairs of vertices, each pair's paths sharing 1.

    No path leaves its component, so components of up to `most_local` edges are one task each. Larger ones are searched
    breadth first from all their vertices with joins, level by level.
    """
    parts = written(_with_component(edges), "components")
    sizes = parts.groupBy("community").agg(F.count("*").alias("k"))
    small = parts.join(sizes.where(F.col("k") <= most_local).select("community"), "community", "left_semi")
    large = parts.join(sizes.where(F.col("k") > most_local).select("community"), "community", "left_semi")

    def local(group: pd.DataFrame) -> pd.DataFrame:
        around = _neighbours(list(zip(group["src"], group["dst"], strict=True)))
        total = _brandes(around, sorted(around))
        return pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["src", "dst", "value"])

    values = small.groupBy("community").applyInPandas(local, "src string, dst string, value double")
    if not large.isEmpty():
        values = values.unionByName(_joined_betweenness(large.select("src", "dst")))
    return values


def _joined_betweenness(edges: DataFrame) -> DataFrame:
    """Betweenness by joins: forward, the vertices of each level with their number of paths; backward, the shares of their edges."""
    both = written(symmetric(edges), "edges")
    level = written(both.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("id"), F.lit(1.0).alias("paths")), "level")
    levels = [level]
    seen = level.select("root", "id")
    while True:
        step = level.join(both, level["id"] == both["src"]).groupBy("root", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["root", "id"], "left_anti").select("root", "id", "paths"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        # A vertex of the next level can only have been met in the last two.
        seen = levels[-1].select("root", "id").unionByName(levels[-2].select("root", "id"))
    shares = None
    credit = levels[-1].select("root", "id", "paths", F.lit(1.0).alias("credit"))
    for upper in reversed(levels[:-1]):
        down = credit.select("root", F.col("id").alias("w"), F.col("paths").alias("wp"), "credit").join(both.select(F.col("src").alias("w"), F.col("dst").alias("id")), "w")
        step = written(down.join(upper, ["root", "id"]).select("root", "id", "w", (F.col("credit") * F.col("paths") / F.col("wp")).alias("share")), "shares")
        shares = step if shares is None else shares.unionByName(step)
        sums = step.groupBy("root", "id").agg(F.sum("share").alias("share"))
        credit = written(upper.join(sums, ["root", "id"], "left").select("root", "id", "paths", (F.coalesce("share", F.lit(0.0)) + 1).alias("credit")), "credit")
    return shares.groupBy(F.least("id", "w").alias("src"), F.greatest("id", "w").alias("dst")).agg((F.sum("share") / 2).alias("value"))


def remove_top_edges(edges: DataFrame, betweenness: DataFrame, rel_tol: float = TIE) -> DataFrame:
    """Edges without all those that are tied for the highest betweenness."""
    top = betweenness.agg(F.max("value")).first()[0]
    if top is None:
        return edges
    gone = betweenness.where(F.col("value") >= F.lit(top * (1 - rel_tol))).select("src", "dst")
    return edges.join(gone, ["src", "dst"], "left_anti")


def modularity(communities: DataFrame, edges: DataFrame, resolution: float = 0.5, scale: float = 0.5) -> DataFrame:
    """(value): scale * sum over communities of E_c / E - resolution * (K_c / 2E)^2, with edges and degrees of the given graph. The
    defaults count every edge twice in the number of edges; 1 and 1 are the textbook's."""
    ids = communities.select("id", "community")
    src, dst = ids.select(F.col("id").alias("src"), F.col("community").alias("cs")), ids.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    placed = edges.join(src, "src").join(dst, "dst")
    rows = placed.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), (F.col("cs") == F.col("cd")).cast("int").alias("inner")), F.struct(F.col("cd").alias("c"), F.lit(0).alias("inner")))).alias("r")).select("r.*")
    sums = rows.groupBy("c").agg(F.sum("inner").alias("e"), F.count("*").alias("k"))
    e = F.sum("k") / 2
    return sums.agg((F.lit(scale) * (F.sum("e") / e - F.lit(resolution) * F.sum(F.col("k") * F.col("k")) / (4 * e * e))).alias("value"))


# Girvan-Newman --------------------------------------------------------------------------------------------------------

_STEPS = "community string, step int, value double, parts int, inner_edges bigint, degree_squares double, ids array<string>, labels array<string>"


def _parts_of(around: dict[str, set[str]], vertices: list[str]) -> dict[str, str]:
    label: dict[str, str] = {}
    for v in sorted(vertices):
        if v in label:
            continue
        label[v] = v
        queue = [v]
        while queue:
            for w in around[queue.pop()]:
                if w not in label:
                    label[w] = v
                    queue.append(w)
    return label


def _split_steps(group: pd.DataFrame) -> pd.DataFrame:
    """The removals of one component until no edge is left: each step's highest value and, when a part splits, the parts."""
    edges = list(zip(group["src"], group["dst"], strict=True))
    around = {v: set(n) for v, n in _neighbours(edges).items()}
    vertices = sorted(around)
    degree = {v: len(n) for v, n in around.items()}
    label = _parts_of(around, vertices)

    def scores(label: dict[str, str]) -> tuple[int, float]:
        sums: dict[str, int] = defaultdict(int)
        for v in vertices:
            sums[label[v]] += degree[v]
        return sum(label[a] == label[b] for a, b in edges), float(sum(k * k for k in sums.values()))

    inner, squares = scores(label)
    name = group["community"].iloc[0]
    rows = [(name, 0, None, 1, inner, squares, vertices, [label[v] for v in vertices])]
    values = _brandes({v: sorted(n) for v, n in around.items()}, vertices)
    parts, step = 1, 0
    while values:
        top = max(values.values())
        gone = [e for e, x in values.items() if x >= top * (1 - TIE)]
        touched = {label[a] for a, _ in gone}
        for a, b in gone:
            around[a].discard(b)
            around[b].discard(a)
        members = [v for v in vertices if label[v] in touched]
        label.update(_parts_of({v: around[v] for v in members}, members))
        # Only parts that lost an edge have other paths now.
        values = {e: x for e, x in values.items() if label[e[0]] not in {label[v] for v in members}}
        values.update(_brandes({v: sorted(around[v]) for v in members}, members))
        step += 1
        now = len(set(label.values()))
        grew = now > parts
        parts = now
        if grew:
            inner, squares = scores(label)
        rows.append((name, step, float(top), parts, inner, squares, vertices if grew else None, [label[v] for v in vertices] if grew else None))
    return pd.DataFrame(rows, columns=["community", "step", "value", "parts", "inner_edges", "degree_squares", "ids", "labels"])


def _merge_steps(steps: pd.DataFrame, total: int, resolution: float, scale: float) -> pd.DataFrame:
    """Iterations of the whole graph: in each, all components whose next removal is tied for the highest value take it."""
    heads: list[tuple[float, str, int]] = []
    by: dict[str, pd.DataFrame] = {c: g.sort_values("step").reset_index(drop=True) for c, g in steps.groupby("community")}
    state = {c: g.iloc[0] for c, g in by.items()}
    inner, squares = sum(int(s.inner_edges) for s in state.values()), sum(float(s.degree_squares) for s in state.values())
    parts, vertices = len(by), int(steps["vertices"].groupby(steps["community"]).first().sum())
    rows = [(0, c, 0, None) for c in by]
    for c, g in by.items():
        if len(g) > 1:
            heads.append((-g.value[1], c, 1))
    heapify(heads)
    iteration = 0
    while heads:
        iteration += 1
        top = -heads[0][0]
        taken = []
        while heads and -heads[0][0] >= top * (1 - TIE):
            taken.append(heappop(heads))
        before = parts
        for _, c, k in taken:
            new, old = by[c].iloc[k], state[c]
            inner += int(new.inner_edges) - int(old.inner_edges)
            squares += float(new.degree_squares) - float(old.degree_squares)
            parts += int(new.parts) - int(old.parts)
            state[c] = new
            if k + 1 < len(by[c]):
                heappush(heads, (-by[c].value[k + 1], c, k + 1))
        if parts == vertices:
            score = None
        else:
            score = scale * (inner / total - resolution * squares / (4 * total * total)) if parts > before else None
        rows += [(iteration, c, k, score) for _, c, k in taken]
    return pd.DataFrame(rows, columns=["iteration", "community", "step", "score"])


def split_steps(edges: DataFrame, most_local: int = 20_000, most_edges: int = 2_000_000, resolution: float = 0.5, scale: float = 0.5) -> DataFrame:
    """(iteration, component, step, score, ids, labels) of Girvan-Newman's removals; see girvan_newman."""
    edges = edges.select("src", "dst")
    parts = written(_with_component(edges), "components")
    sizes = parts.groupBy("community").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"), F.sum("k").alias("total")).first()
    if (sizes.most or 0) > most_local or (sizes.total or 0) > most_edges:
        raise ValueError(f"removal takes edges times paths: components up to {most_local} edges and graphs up to {most_edges} are served")
    total = int(sizes.total or 1)
    steps = written(parts.groupBy("community").applyInPandas(_split_steps, _STEPS), "steps")
    light = steps.select("community", "step", "value", "parts", "inner_edges", "degree_squares", F.max(F.size("ids")).over(Window.partitionBy("community")).alias("vertices"))
    # One small row per removal: their order over the whole graph is one sequence, bounded by most_edges.
    order = light.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda g: _merge_steps(g, total, resolution, scale), "iteration int, community string, step int, score double")
    return written(order, "order").join(steps.select("community", "step", "ids", "labels"), ["community", "step"])


def gn_dendrogram(edges: DataFrame, **options: float) -> DataFrame:
    """(iteration, communities, value): the iterations of Girvan-Newman that were scored, with the number of communities then. `iteration` 0, the
    graph's own components, is never scored."""
    steps = split_steps(edges, **options)
    counts = steps.where("labels is not null").select("iteration", "community", F.size(F.array_distinct("labels")).alias("now"), "score")
    before = F.lag("now", 1, 0).over(Window.partitionBy("community").orderBy("iteration"))
    grown = counts.withColumn("more", F.col("now") - before).groupBy("iteration").agg(F.sum("more").alias("more"))
    scores = steps.groupBy("iteration").agg(F.max("score").alias("value"))
    # One row per iteration that split something: a short report, whose running sum is one sequence.
    so_far = grown.withColumn("communities", F.sum("more").over(Window.orderBy("iteration"))).drop("more")
    total = scores.where("value is not null").join(so_far, "iteration")
    return total.select("iteration", "communities", F.round("value", 6).alias("value"))


def dendrogram_members(edges: DataFrame, **options: float) -> DataFrame:
    """(iteration, id, community): the communities of every vertex at each of the iterations of Girvan-Newman that were scored (see gn_dendrogram).

    A component's parts stay as they are until it splits again: each of its states is repeated for the scored iterations up to the next.
    """
    steps = split_steps(edges, **options)
    scored = steps.where("score is not null").select("iteration").distinct()
    # One row per scored iteration, fewer than vertices: numbered in one sequence.
    scored = written(scored.withColumn("s", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("iteration"))), "scored")
    most = scored.agg(F.max("s")).first()[0]
    # Components that split have labels at iterations that were scored, at 0, or at the last, at which all vertices are alone.
    states = steps.where("labels is not null").join(scored, "iteration", "left").withColumn("s", F.when(F.col("iteration") == 0, 0).otherwise(F.coalesce("s", F.lit((most or 0) + 1))))
    until = F.lead("s", 1, (most or 0) + 1).over(Window.partitionBy("community").orderBy("iteration"))
    states = states.withColumn("until", until - 1).withColumn("s", F.greatest("s", F.lit(1))).where("s <= until")
    rows = states.select("ids", "labels", F.explode(F.sequence("s", "until")).alias("s")).join(scored, "s")
    return rows.select("iteration", F.explode(F.arrays_zip("ids", "labels")).alias("m")).select("iteration", F.col("m.ids").alias("id"), F.col("m.labels").alias("community"))


def girvan_newman(edges: DataFrame, resolution: float = 0.5, scale: float = 0.5, **options: float) -> DataFrame:
    """(iteration, id, community, value): the communities with the highest modularity along Girvan-Newman's removals, the earliest of equal ones.

    Each iteration removes all edges tied for the highest betweenness; a score counts when the number of components grew; the state in which
    all vertices are alone is not scored. If nothing was scored, the result is the graph's components, with iteration 0 and a null value.
    Modularity is that of modularity().

    Components don't touch each other's paths, so each is taken apart in a task of its own, and their removals are put in order after.
    """
    steps = split_steps(edges, resolution=resolution, scale=scale, **options)
    best = steps.where("score is not null").groupBy("iteration").agg(F.max("score").alias("score")).orderBy(F.desc(F.round("score", 12)), "iteration").first()
    iteration, value = (best.iteration, best.score) if best else (0, None)
    last = Window.partitionBy("community").orderBy(F.desc("iteration"))
    state = steps.where((F.col("iteration") <= iteration) & F.col("labels").isNotNull()).withColumn("r", F.row_number().over(last)).where("r = 1")
    members = state.select(F.explode(F.arrays_zip("ids", "labels")).alias("m")).select(F.col("m.ids").alias("id"), F.col("m.labels").alias("community"))
    return members.select(F.lit(iteration).alias("iteration"), "id", "community", F.lit(value).cast("double").alias("value"))


def community_listing(communities: DataFrame) -> DataFrame:
    """(size, members) of communities (id, community), or (id, label) as label_propagation gives them: members sorted, communities by size and then members. A community's list is one row, as it is the report's form."""
    lists = communities.groupBy("community" if "community" in communities.columns else "label").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return lists.select(F.size("members").alias("size"), "members").orderBy("size", "members")
