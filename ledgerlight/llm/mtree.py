"""Exact top-k by inner product with paged M-trees.

With R the largest norm of a tree's vectors, a vector x gets one more component sqrt(R^2 - |x|^2) and a query q a zero: then
|q' - x'|^2 = |q|^2 + R^2 - 2 q.x, and the nearest in this metric space are those of the largest inner product.

Sampled vectors are routing objects. Every vector goes to its nearest one, a well-filled object's vectors over several
salts, and the vectors of a branch are one M-tree, built once: pages of at most PAGE entries, and above them nodes of at
most FAN, each with a routing object (one of its vectors), a covering radius and the distance to its parent's routing
object, as each entry has to its page's. Queries meet trees in blocks. A search goes down level by level; a child or an
entry whose stored distance to the parent leaves no room for the k-th score is passed over without computing its own. Then
each query takes its pages best first, those with the least possible distance, until none can hold a better score. Every
query searches the tree that holds it first, and takes its k-th score along to the others; a tree whose root cannot beat it
is not visited. Bounds have slack for rounding, scores are exact, equal scores go to the smaller vec_id.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. Shorter vectors
count as filled up with zeros. Scores beyond a long are the nearest long; they rank by their true value. Rows that repeat a
vec_id are rows of their own; a query never finds rows with its own vec_id, and a vec_id's query rows answer once, for the
same one of its vectors in every run. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

SCALE = 64
TOP = 20
ROUTES = 64  # vectors sampled as routing objects
BRANCH = 8192  # vectors of a tree, about
PAGE = 256
FAN = 8
QUERIES = 4096  # queries of a block
ROOTS = 1 << 25  # bytes of roots up to which they go to every task, so that queries skip trees
_EXACT = float(1 << 52)  # products below this are exact in doubles
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of double, whole numbers): floor(scale * x) of valid vectors."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & ~bad)
    # doubles of 2^53 and more are whole; there the product with a scale that is no power of two is rounded
    whole = lambda x: F.when(F.abs(x) < 1e15, F.floor(x * scale).cast("double")).otherwise(F.least(F.greatest(x * scale, F.lit(-1e300)), F.lit(1e300)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x.cast("double"))).alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, without overflow."""
    top = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1.0)
    return np.sqrt(((x / top[:, None]) ** 2).sum(1)) * top


def _product(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


class Tree:
    """An M-tree. levels: from the root down, arrays of nodes (routing object, radius, parent in the level above, distance to
    its routing object); the last level are the pages, whose entries lie one after another, by distance to the routing object."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norms = ids, x, _norms(x)
        self.reach = float(self.norms.max(initial=0.0))
        self.points = self._lifted(x, self.norms)
        pages = self._split(np.arange(len(ids)), PAGE)
        levels: list[list[np.ndarray]] = [pages]
        while len(levels[0]) > 1:
            # neighbours in the order of the splits share a parent
            levels.insert(0, [np.concatenate(levels[0][i : i + FAN]) for i in range(0, len(levels[0]), FAN)])
        self.levels: list[dict[str, np.ndarray]] = []
        for depth, level in enumerate(levels):
            routing = [self._medoid(rows) for rows in level]
            points = self.points[routing]
            radius = np.array([self._far(rows, p).max() for rows, p in zip(level, points, strict=True)])
            parent = np.arange(len(level)) // FAN if depth else np.zeros(len(level), np.int64)
            away = np.linalg.norm(points - self.levels[-1]["points"][parent], axis=1) if depth else np.zeros(len(level))
            self.levels.append({"points": points, "radius": radius, "parent": parent, "away": away})
        order, away = [], []
        for rows, p in zip(pages, self.levels[-1]["points"], strict=True):
            d = self._far(rows, p)
            by = np.argsort(d, kind="stable")
            order.append(rows[by])
            away.append(d[by])
        order_ = np.concatenate(order)
        self.ids, self.x, self.norms, self.points = ids[order_], x[order_], self.norms[order_], self.points[order_]
        self.away = np.concatenate(away)
        self.ends = np.cumsum([len(p) for p in pages])

    def _lifted(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, (self.reach - norms) * (self.reach + norms))) if self.reach < 1e150 else np.zeros(len(x))
        return np.hstack([x, rest[:, None]])

    def _far(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.points[rows] - p, axis=1)

    def _medoid(self, rows: np.ndarray) -> int:
        return int(rows[self._far(rows, self.points[rows].mean(0)).argmin()])

    def _split(self, rows: np.ndarray, most: int) -> list[np.ndarray]:
        """Pages: two far points promote, the rest goes half and half by their difference in distance."""
        if len(rows) <= most:
            return [rows]
        first = self._far(rows, self.points[rows[0]])
        a = self.points[rows[first.argmax()]]
        from_a = self._far(rows, a)
        b = self.points[rows[from_a.argmax()]]
        by = np.argsort(from_a - self._far(rows, b), kind="stable")
        half = len(rows) // 2
        return self._split(rows[by[:half]], most) + self._split(rows[by[half:]], most)

    def root(self) -> tuple[np.ndarray, float, float]:
        return self.levels[0]["points"][0], float(self.levels[0]["radius"][0]), self.reach

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(query number, row, score) of each query's best entries: k at most, of a score of at least least[query]."""
        norms = _norms(queries)
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        slack = 1e-6 + 1e-9 * (self.reach + norms)
        kth = least.copy()  # scores below it cannot enter
        limit = _limit(norms, self.reach, kth) + slack
        possible = np.ones((len(queries), 1), bool)
        distance = np.zeros((len(queries), 1))
        for depth, level in enumerate(self.levels):
            above = level["parent"]
            # the parent's distance and the stored one bound a child's own, which is then not computed
            open_ = possible[:, above] & (np.abs(distance[:, above] - level["away"]) - level["radius"] <= limit[:, None]) if depth else possible
            computed = np.full(open_.shape, np.inf)
            for node in np.flatnonzero(open_.any(0)).tolist():
                q = np.flatnonzero(open_[:, node])
                computed[q, node] = np.linalg.norm(lifted[q] - level["points"][node], axis=1)
            possible = open_ & (computed - level["radius"] <= limit[:, None])
            distance = np.where(np.isinf(computed), 0.0, computed)
        nearest = np.where(possible, np.maximum(0.0, distance - self.levels[-1]["radius"]), np.inf)
        order = np.argsort(nearest, axis=1, kind="stable")
        best = _Best(self, queries, norms, own, k, kth)
        for turn in range(order.shape[1]):
            page = order[:, turn]
            go = np.flatnonzero(nearest[np.arange(len(queries)), page] <= _limit(norms, self.reach, best.kth) + slack)
            if not len(go):
                break
            by = go[np.argsort(page[go], kind="stable")]
            for group in np.split(by, np.flatnonzero(np.diff(page[by])) + 1):
                p = int(page[group[0]])
                a, b = int(self.ends[p - 1]) if p else 0, int(self.ends[p])
                room = _limit(norms[group], self.reach, best.kth[group]) + slack[group]
                low, high = (distance[group, p] - room).min(), (distance[group, p] + room).max()
                best.take(group, a + int(np.searchsorted(self.away[a:b], low)), a + int(np.searchsorted(self.away[a:b], high, side="right")))
        return best.result()


def _limit(norms: np.ndarray, reach: float, kth: np.ndarray) -> np.ndarray:
    """The distance at which a score is kth."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = norms * norms + reach * reach - 2 * kth
    return np.where(np.isfinite(square), np.sqrt(np.maximum(0.0, np.where(np.isfinite(square), square, 0.0))), np.inf)


class _Best:
    """The k best entries of each query so far."""

    def __init__(self, tree: Tree, queries: np.ndarray, norms: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray):
        self.tree, self.queries, self.norms, self.own, self.k, self.kth = tree, queries, norms, own, k, kth
        self.q, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if self._wide(norms) else float)

    def _wide(self, norms: np.ndarray) -> bool:
        """Whether products may be inexact in doubles; then they are whole numbers of Python."""
        return bool(norms.max(initial=0.0) * self.tree.reach >= _EXACT)

    def take(self, group: np.ndarray, a: int, b: int) -> None:
        if a >= b:
            return
        tree, q = self.tree, self.queries[group]
        with np.errstate(over="ignore", invalid="ignore"):
            score = q @ tree.x[a:b].T
        # rounding: nothing where products are exact
        size = self.norms[group][:, None] * tree.norms[a:b][None, :]
        rough = np.where(size >= _EXACT, size * 1e-12, 0.0)
        with np.errstate(invalid="ignore"):
            new = ~(score + rough < self.kth[group][:, None]) & (tree.ids[a:b][None, :] != self.own[group][:, None])
        i, j = np.nonzero(new)
        if not len(i):
            return
        if self.score.dtype == object:
            found = np.array([_product(q[x], tree.x[a + y]) if size[x, y] >= _EXACT else int(score[x, y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], object)
        else:
            found = score[i, j]
        mine = np.isin(self.q, group)
        numbers, rows, scores = np.concatenate([self.q[mine], group[i]]), np.concatenate([self.row[mine], j + a]), np.concatenate([self.score[mine], found])
        if scores.dtype == object:
            order = np.array(sorted(range(len(scores)), key=lambda x: (numbers[x], -scores[x], tree.ids[rows[x]])), np.int64)
        else:
            order = np.lexsort((tree.ids[rows], -scores, numbers))
        numbers, rows, scores = numbers[order], rows[order], scores[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        count = np.diff(np.append(first, len(numbers)))
        rank = np.arange(len(numbers)) - np.repeat(first, count)
        last = np.flatnonzero(rank == self.k - 1)
        self.kth[numbers[last]] = np.maximum(self.kth[numbers[last]], _floats(scores[last]))
        keep = rank < self.k
        self.q, self.row, self.score = (np.concatenate([x[~mine], y[keep]]) for x, y in ((self.q, numbers), (self.row, rows), (self.score, scores)))

    def result(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        return self.q, self.row, [int(s) for s in self.score.tolist()]


def _floats(scores: np.ndarray) -> np.ndarray:
    """Doubles not above the scores."""
    if scores.dtype != object:
        return scores
    return np.array([np.nextafter(float(max(min(s, 10**300), -(10**300))), -np.inf) for s in scores.tolist()], float)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    branch: int = BRANCH, query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query (a condition on the id) holds, against all rows."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    points = cut(quantized(named, "vec_id", "v", scale))
    seen = points.agg(F.max(F.size("v")), F.count("*")).first()
    dims, n = int(seen[0] or 0), int(seen[1])
    routes = [r["v"] for r in points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROUTES).select("v").collect()]
    routing = _matrix(pd.Series(routes), dims)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], dims)
            # by direction: rounding, and vectors of other lengths, only change which tree holds a vector
            unit, other = (v / np.maximum(_norms(v), 1.0)[:, None] for v in (x, routing))
            near = (unit @ other.T).argmax(1) if len(routing) else np.zeros(len(x), int)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [r.astype("<f8").tobytes() for r in x], "route": near})

    routed = cut(points.mapInPandas(route, "vec_id long, v binary, route int"))
    salts = routed.groupBy("route").agg(F.ceil(F.count("*") / branch).alias("salts"))  # a row for each routing object
    routed = routed.join(F.broadcast(salts), "route").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    trees = max(1, -(-n // branch))
    routed = routed.select("vec_id", "v", F.pmod(F.xxhash64("route", "salt"), F.lit(trees)).cast("int").alias("branch"))  # small branches share a tree

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["v"]), "<f8").reshape(len(rows), dims)
        tree = Tree(rows["vec_id"].to_numpy(np.int64), x)
        p, radius, reach = tree.root()
        return pd.DataFrame({"branch": [key[0]], "tree": [pickle.dumps(tree, 5)], "root": [np.concatenate([p, [radius, reach]]).tobytes()]})

    grown = cut(routed.groupBy("branch").applyInPandas(build, "branch int, tree binary, root binary"))

    def found(tree: Tree, rows: pd.DataFrame, least: np.ndarray) -> tuple[list, np.ndarray]:
        queries = np.frombuffer(b"".join(rows["v"]), "<f8").reshape(len(rows), dims)
        q, row, score = tree.search(queries, rows["vec_id"].to_numpy(np.int64), k, least)
        return list(zip(rows["vec_id"].to_numpy()[q].tolist(), tree.ids[row].tolist(), score, strict=True)), q

    # one vector answers for a repeated vec_id; a query starts in the tree that holds it
    blocks = max(1, -(-points.where(is_query).count() // query_block))
    asked = routed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "branch")).alias("q")).select("vec_id", "q.v", F.col("q.branch").alias("home"))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    schema = "query_id long, vec_id long, score decimal(38,0), kth double"
    columns = ["query_id", "vec_id", "score", "kth"]

    def search(key: tuple, tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(tree) and len(rows):
            held, least = pickle.loads(tree["tree"].iloc[0]), rows["kth"].to_numpy(float)
            hits, q = found(held, rows, least)
            count = np.bincount(q, minlength=len(rows))
            kth = {v: -np.inf for v in rows["vec_id"].tolist()}
            worst: dict[int, int] = {}
            for v, _, s in hits:
                worst[v] = min(worst.get(v, s), s)
            for v, c in zip(rows["vec_id"].tolist(), count.tolist(), strict=True):
                if c >= k:
                    kth[v] = float(_floats(np.array([worst[v]], object))[0])
            out = [(v, i, _decimal(s), kth[v]) for v, i, s in hits]
        return pd.DataFrame(out, columns=columns)

    tree_at = grown.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("branch", "block", "tree")
    at_home = asked.select("vec_id", "v", F.col("home").alias("branch"), "block", F.lit(float("-inf")).alias("kth"))
    first = cut(tree_at.groupBy("branch", "block").cogroup(at_home.groupBy("branch", "block")).applyInPandas(search, schema))
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.max("kth").alias("kth"))
    with_kth = asked.join(kth, asked["vec_id"] == kth["id"], "left").select("vec_id", "v", "home", "block", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))

    # the other trees, but for those whose roots cannot beat the k-th score
    if 8 * (dims + 3) * trees <= ROOTS:
        roots = {r["branch"]: np.frombuffer(r["root"], "<f8") for r in grown.select("branch", "root").collect()}

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                q = np.frombuffer(b"".join(b["v"]), "<f8").reshape(len(b), dims)
                norms, least, home = _norms(q), b["kth"].to_numpy(float), b["home"].to_numpy()
                for number, r in roots.items():
                    p, radius, reach = r[:-2], r[-2], r[-1]
                    away = np.sqrt(((q - p[:-1]) ** 2).sum(1) + p[-1] ** 2)
                    go = (home != number) & (away - radius <= _limit(norms, reach, least) + 1e-6 + 1e-9 * (reach + norms))
                    if go.any():
                        yield b.loc[go, ["vec_id", "v", "block", "kth"]].assign(branch=np.int32(number))

        rest = with_kth.mapInPandas(visits, "vec_id long, v binary, block int, kth double, branch int")
    else:
        rest = with_kth.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where("branch != home").drop("home")
    more = tree_at.groupBy("branch", "block").cogroup(rest.select("vec_id", "v", "branch", "block", "kth").groupBy("branch", "block")).applyInPandas(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.union(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-_LONG - 1)), F.lit(_LONG)).cast("long").alias("score"))


def _decimal(score: int):
    from decimal import Decimal

    return Decimal(max(min(score, 10**38 - 1), 1 - 10**38))
