"""Distances between rows at any number of rows: nearest rows, counts within a
radius, density clusters and distance sums, without a cross join of rows.

Rows are dealt out by their nearest pivot and cut into blocks of nearby rows, each
in a ball (centre, radius).  Neighbouring blocks form groups of ``GROUP_ROWS``
rows.  A row goes only to the groups whose rows it can concern: by the triangle
inequality two rows are at least as far apart as their balls' centres less both
radii.  A task holds the rows of one group and lets those of others stream by, as
matrix products of pieces; what a piece's ball rules out is not multiplied.  Where
a product's rounding could decide, the distance is computed again from differences.

Tasks give results of their own rows only (the nearest, a count, links between
local clusters, a sum): pairs of rows are never written.  The driver holds one
ball a block, of which there are some ``BLOCKS_MOST``.

Vectors of unequal lengths count as if zeros followed the shorter; rows without a
vector take no part.  Ids must be distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import components, in_folder

BLOCK_ROWS, BLOCKS_MOST = 1024, 16_384
GROUP_ROWS = 16_384
PIVOTS_MOST = 1024
PIECE_ROWS = 256
#: Numbers in a group's table of sums.
SUMS_MOST = 1 << 24
_ROW = "block long, id long, v binary, tag long"
_INF = float("inf")


@dataclass(frozen=True)
class Balls:
    """One row a block, in order of blocks: group, rows, centre, radius and
    ``reach``, beyond which no nearest row of its rows lies."""

    block: np.ndarray
    group: np.ndarray
    n: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    reach: np.ndarray

    def gaps(self, k: int) -> np.ndarray:
        """Least possible distance of rows of each block to rows of block k."""
        d = np.sqrt(((self.centre - self.centre[k]) ** 2).sum(1))
        return d - self.radius - self.radius[k] - 1e-9 * (d + 1)

    def groups_of(self, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups, gaps): where rows of block k can be within the blocks' limits."""
        gap = self.gaps(k)
        at = np.flatnonzero(gap <= limit)
        groups = np.unique(self.group[at])
        least = np.full(len(groups), _INF)
        np.minimum.at(least, np.searchsorted(groups, self.group[at]), gap[at])
        return groups, np.maximum(least, 0.0)


@dataclass
class Blocks:
    rows: DataFrame  # block, id, v, tag
    balls: Balls
    dims: int
    extra: dict = field(default_factory=dict)


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), dims)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a product; see :func:`slack` for their error."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0.0)


def slack(a: np.ndarray, b: np.ndarray) -> float:
    return 1e-14 * (a.shape[1] + 4) * (float((a * a).sum(1).max(initial=0)) + float((b * b).sum(1).max(initial=0)))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows are at most ``eps`` apart, exactly."""
    s, e = squares(a, b), slack(a, b)
    near = s <= eps * eps - e
    i, j = np.nonzero((s <= eps * eps + e) & ~near)
    for at in range(0, len(i), 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        near[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1)) <= eps
    return near


def _bisected(points: np.ndarray) -> np.ndarray:
    """An order in which neighbours in space stand together."""

    def halves(at):
        if len(at) < 3:
            return at
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        at = at[np.argsort(points[at, axis], kind="stable")]
        return np.concatenate([halves(at[: len(at) // 2]), halves(at[len(at) // 2 :])])

    return halves(np.arange(len(points)))


def blocked(df: DataFrame, folder, row_id: str, vector: str, tag: str | None = None, k: int = 0, group_rows: int | None = None) -> Blocks:
    """Blocks of the rows, in ``folder`` (see :func:`in_folder`); ``k``: their
    reach is that of the k-th nearest row."""
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag")).where("v IS NOT NULL")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    block_rows = max(BLOCK_ROWS, -(-n // BLOCKS_MOST))

    def dense(col: pa.Array) -> np.ndarray:
        lens = np.asarray(pa.compute.list_value_length(col)).astype(np.int64)
        values = col.flatten().to_numpy(zero_copy_only=False)
        if (lens == dims).all():
            return values.reshape(len(col), dims)
        out = np.zeros((len(col), dims))
        out[np.repeat(np.arange(len(col)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
        return out

    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS_MOST, n // block_rows))).select("v").toArrow()
    pivots = dense(some.column(0).combine_chunks()) if some.num_rows else np.zeros((1, dims))
    pivots = spark.sparkContext.broadcast(pivots[_bisected(pivots)])

    def placed(batches):
        for batch in batches:
            x = dense(batch.column(1))
            cell = np.concatenate([squares(x[i : i + 4096], pivots.value).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], ["cell", "id", "v", "tag"])

    def ball(x: np.ndarray) -> tuple[bytes, float, float]:
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        reach = _INF
        if 0 < k <= len(x):
            far = [np.partition(squares(x[i : i + PIECE_ROWS], x), k - 1, axis=1)[:, k - 1].max() for i in range(0, len(x), PIECE_ROWS)]
            reach = float(np.sqrt(max(far) + slack(x, x)))
        return centre.tobytes(), radius, reach

    def cut(batches):
        from pyspark import TaskContext

        block, held, cell = TaskContext.get().partitionId() << 32, [], None

        def made(parts):
            t = pa.concat_batches(parts)
            x = matrix(t.column(1), dims)
            centre, radius, reach = ball(x)
            m = len(x)
            first = lambda value, kind: pa.array([value] + [None] * (m - 1), kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, block)), *t.columns, first(m, pa.int64()), first(centre, pa.binary()), first(radius, pa.float64()), first(reach, pa.float64())],
                ["block", "id", "v", "tag", "n", "centre", "radius", "reach"],
            )

        size = 0
        for batch in batches:
            cells = np.asarray(batch.column(0))
            rest = batch.select(["id", "v", "tag"])
            i = 0
            while i < len(cells):
                if size and (cells[i] != cell or size >= block_rows):
                    yield made(held)
                    block, held, size = block + 1, [], 0
                cell = cells[i]
                j = min(int(np.searchsorted(cells[i:], cell, "right")) + i, i + block_rows - size)
                held.append(rest.slice(i, j - i))
                size += j - i
                i = j
        if size:
            yield made(held)

    ordered = rows.mapInArrow(placed, "cell int, id long, v binary, tag long").repartitionByRange(width, "cell", "id").sortWithinPartitions("cell", "id")
    table = folder.write(ordered.mapInArrow(cut, f"{_ROW}, n long, centre binary, radius double, reach double"))
    found = table.where("centre IS NOT NULL").select("block", "n", "centre", "radius", "reach").toArrow().sort_by("block")
    size = np.asarray(found.column("n")).astype(np.int64)
    group_rows = group_rows or GROUP_ROWS
    balls = Balls(
        np.asarray(found.column("block")), ((np.cumsum(size) - size) // group_rows).astype(np.int32), size,
        matrix(found.column("centre").combine_chunks(), dims) if len(size) else np.zeros((0, dims)), np.asarray(found.column("radius")), found.column("reach").to_numpy().copy(),
    )
    for q in np.flatnonzero(np.isinf(balls.reach)) if 0 < k <= n else ():  # too few rows of its own: those of the nearest balls
        d = np.sqrt(((balls.centre - balls.centre[q]) ** 2).sum(1)) + balls.radius + balls.radius[q]
        order = np.argsort(d)
        balls.reach[q] = d[order][np.searchsorted(np.cumsum(size[order]), k)] * (1 + 1e-9) + 1e-12
    return Blocks(table.select("block", "id", "v", "tag"), balls, dims)


class Own:
    """The rows of a group that a task holds, in pieces with balls."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int):
        t = pa.concat_batches(parts)
        self.block, self.id, self.tag = (np.asarray(pa.compute.fill_null(t.column(c), 0)) for c in ("block", "id", "tag"))
        self.tagged = np.asarray(t.column("tag").is_valid())
        self.x = matrix(t.column("v"), dims)
        self.pieces = []
        for i in range(0, len(self.x), PIECE_ROWS):
            p = self.x[i : i + PIECE_ROWS]
            centre = p.mean(0)
            self.pieces.append((i, i + len(p), centre, float(np.sqrt(((p - centre) ** 2).sum(1).max()))))

    def meeting(self, x: np.ndarray, limit: Callable[[int, int], float]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, rows of x) for each piece and the rows that its ball and
        limit don't rule out."""
        for i, j, centre, radius in self.pieces:
            top = limit(i, j)
            if top == _INF:
                yield i, j, np.arange(len(x))
                continue
            d = np.sqrt(((x - centre) ** 2).sum(1))
            at = np.flatnonzero(d - radius - 1e-9 * (d + 1) <= top)
            if len(at):
                yield i, j, at


def crossed(blocks: Blocks, limit: np.ndarray, begin, step, finish, schema: str, own: str = "true", other: str = "true", later: bool = False) -> DataFrame:
    """Streams rows by the groups they can concern.  ``limit``: of each block, how
    far its rows look; ``begin(own)``, ``step(state, id, x, tag)`` and
    ``finish(state)``, which yields record batches.  ``own`` and ``other`` choose
    rows by their tag; ``later``: only groups that come before a row's own."""
    spark, dims = blocks.rows.sparkSession, blocks.dims
    sent = spark.sparkContext.broadcast((blocks.balls, limit))

    def deal(batches):
        balls, limit = sent.value
        for batch in batches:
            known, inverse = np.unique(np.asarray(batch.column(0)), return_inverse=True)
            at = np.searchsorted(balls.block, known)
            is_own, is_other = (np.asarray(batch.column(c)) for c in ("own", "other"))
            plain = batch.select(["block", "id", "v", "tag"])

            def part(rows, group, role, gap, plain=plain):
                for i in range(0, len(rows), 8192):
                    r = plain.take(pa.array(rows[i : i + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(group[i : i + 8192]), pa.array(np.full(r.num_rows, role, np.int32)), pa.array(gap[i : i + 8192]), *r.columns], ["group", "role", "gap", *r.schema.names])

            rows = np.flatnonzero(is_own)
            yield from part(rows, balls.group[at][inverse[rows]], 0, np.zeros(len(rows)))
            for k in range(len(known)):
                rows = np.flatnonzero((inverse == k) & is_other)
                groups, gap = balls.groups_of(at[k], limit)
                if later:
                    before = groups < balls.group[at[k]]
                    groups, gap = groups[before], gap[before]
                if len(rows) and len(groups):
                    yield from part(np.tile(rows, len(groups)), np.repeat(groups, len(rows)), 1, np.repeat(gap, len(rows)))

    def run(batches):
        group, mine, state = None, [], None
        for batch in batches:
            key = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(i, j - i)
                if key[i] // 2 != group:
                    if mine:
                        yield from finish(state if state is not None else begin(Own(mine, dims)))
                    group, mine, state = key[i] // 2, [], None
                if key[i] % 2 == 0:
                    mine.append(part)
                elif mine:
                    state = begin(Own(mine, dims)) if state is None else state
                    step(state, np.asarray(part.column("id")), matrix(part.column("v"), dims), np.asarray(pa.compute.fill_null(part.column("tag"), 0)))
        if mine:
            yield from finish(state if state is not None else begin(Own(mine, dims)))

    marked = blocks.rows.withColumns({"own": F.coalesce(F.expr(own), F.lit(False)), "other": F.coalesce(F.expr(other), F.lit(False))})
    dealt = marked.mapInArrow(deal, f"group int, role int, gap double, {_ROW}")
    groups = int(blocks.balls.group.max(initial=0)) + 1
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return dealt.repartition(max(width, min(groups, 8 * width)), "group").sortWithinPartitions("group", "role", "gap", "block", "id").mapInArrow(run, schema)


# nearest rows -----------------------------------------------------------------
class _Nearest:
    def __init__(self, own: Own, k: int):
        self.own, self.k = own, k
        self.d = np.full((len(own.x), k), _INF)

    def step(self, _ids, x, _tag):
        for i, j, at in self.own.meeting(x, lambda i, j: float(self.d[i:j, -1].max())):
            a, b = self.own.x[i:j], x[at]
            s, e = squares(a, b), slack(a, b)
            near = s <= (self.d[i:j, -1] ** 2 + e)[:, None]
            if np.count_nonzero(near) > 8 * self.k * (j - i) and len(at) > self.k:  # about k of a row's are enough
                near &= s <= (np.partition(s, self.k - 1, axis=1)[:, self.k - 1] + e)[:, None]
            p, q = np.nonzero(near)
            if len(p):
                d = np.sqrt(((a[p] - b[q]) ** 2).sum(1))
                row = np.concatenate([np.repeat(np.arange(j - i), self.k), p])
                d = np.concatenate([self.d[i:j].ravel(), d])
                order = np.lexsort((d, row))
                row, d = row[order], d[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                self.d[i:j] = d[rank < self.k].reshape(j - i, self.k)

    def result(self):
        for i in range(0, len(self.d), 8192):
            d = self.d[i : i + 8192]
            row, rank = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(self.own.id[i : i + 8192][row]), pa.array((rank + 1).astype(np.int32)), pa.array(d[row, rank])], ["id", "rank", "d"])


def nearest(df: DataFrame, folder, k: int, row_id: str, vector: str) -> DataFrame:
    """(id, rank, d): distances to the k nearest rows of each, itself among them."""
    blocks = blocked(df, folder, row_id, vector, k=k)
    return crossed(blocks, blocks.balls.reach, lambda own: _Nearest(own, k), lambda s, *a: s.step(*a), lambda s: s.result(), "id long, rank int, d double")


# density clusters -------------------------------------------------------------
class _Counts:
    """Rows within eps; once all have passed, the group's own clusters."""

    def __init__(self, own: Own, eps: float, least: int):
        self.own, self.eps, self.least = own, eps, least
        self.n = np.zeros(len(own.x), np.int64)

    def step(self, _ids, x, _tag):
        for i, j, at in self.own.meeting(x, lambda i, j: self.eps):
            self.n[i:j] += within(self.own.x[i:j], x[at], self.eps).sum(1)

    def result(self):
        own, core = self.own, np.flatnonzero(self.n >= self.least)
        x, label = own.x[core], np.full(len(core), -1, np.int64)
        for first in range(len(core)):
            if label[first] >= 0:
                continue
            label[first], front = first, np.array([first])
            while len(front):  # rows that are reached leave the search
                left = np.flatnonzero(label < 0)
                if not len(left):
                    break
                hit = np.zeros(len(left), bool)
                for i in range(0, len(front), PIECE_ROWS):
                    rest = np.flatnonzero(~hit)
                    hit[rest] = within(x[front[i : i + PIECE_ROWS]], x[left[rest]], self.eps).any(0)
                front = left[hit]
                label[front] = first
        least = np.full(len(core), np.iinfo(np.int64).max)
        np.minimum.at(least, label, own.id[core])
        name, known = np.zeros(len(own.x), np.int64), np.zeros(len(own.x), bool)
        name[core], known[core] = least[label], True
        for i in range(0, len(own.x), 8192):
            s = slice(i, i + 8192)
            yield pa.RecordBatch.from_arrays([pa.array(own.block[s]), pa.array(own.id[s]), pa.array([r.tobytes() for r in own.x[s]], pa.binary()), pa.array(name[s], mask=~known[s])], ["block", "id", "v", "tag"])


class _Links:
    """Links between clusters of different groups, each once."""

    def __init__(self, own: Own, eps: float):
        self.own, self.eps, self.found = own, eps, set()

    def step(self, _ids, x, tag):
        order = np.argsort(tag, kind="stable")
        x, tag = x[order], tag[order]
        for i, j, at in self.own.meeting(x, lambda i, j: self.eps):
            mine = np.argsort(self.own.tag[i:j], kind="stable")
            a, b = self.own.tag[i:j][mine], tag[at]
            near = within(self.own.x[i:j][mine], x[at], self.eps)
            first_a, first_b = (np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) for t in (a, b))
            near = np.logical_or.reduceat(np.logical_or.reduceat(near, first_a, axis=0), first_b, axis=1)
            p, q = np.nonzero(near)
            self.found.update(zip(a[first_a][p].tolist(), b[first_b][q].tolist(), strict=True))

    def result(self):
        if self.found:
            a, b = zip(*sorted(self.found), strict=True)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})


class _Border:
    """The least cluster within eps of rows that have none."""

    def __init__(self, own: Own, eps: float):
        self.own, self.eps = own, eps
        self.label = np.full(len(own.x), np.iinfo(np.int64).max)

    def step(self, _ids, x, tag):
        top = np.iinfo(np.int64).max
        for i, j, at in self.own.meeting(x, lambda i, j: self.eps):
            near = within(self.own.x[i:j], x[at], self.eps)
            self.label[i:j] = np.minimum(self.label[i:j], np.where(near, tag[at][None], top).min(1))

    def result(self):
        found = self.label < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(self.own.id[found]), pa.array(self.label[found])], ["id", "label"])


def density_clusters(df: DataFrame, folder, eps: float, least: int, row_id: str, vector: str) -> DataFrame:
    """(id, label) of the rows in a cluster: ``label`` is its least core row, a
    border row has the least label within eps.  Each group finds the clusters of
    its own core rows; links between these, once each, are joined by stars."""
    blocks = blocked(df, folder, row_id, vector)
    limit = np.full(len(blocks.balls.block), float(eps))
    counted = crossed(blocks, limit, lambda own: _Counts(own, eps, least), lambda s, *a: s.step(*a), lambda s: s.result(), _ROW)
    blocks = Blocks(folder.write(counted), blocks.balls, blocks.dims)
    core, rest = "tag IS NOT NULL", "tag IS NULL"
    links = folder.write(crossed(blocks, limit, lambda own: _Links(own, eps), lambda s, *a: s.step(*a), lambda s: s.result(), "a long, b long", core, core, later=True))
    roots = components(links, folder).withColumnRenamed("node", "tag")
    # a local cluster has the rows of one group at most, so no key is hot
    named = blocks.rows.join(roots, "tag", "left").select("block", "id", "v", F.coalesce("root", "tag").alias("tag"))
    blocks = Blocks(folder.write(named), blocks.balls, blocks.dims)
    border = crossed(blocks, limit, lambda own: _Border(own, eps), lambda s, *a: s.step(*a), lambda s: s.result(), "id long, label long", rest, core)
    return blocks.rows.where(core).select("id", F.col("tag").alias("label")).unionByName(border)


# distance sums ----------------------------------------------------------------
class _Sums:
    def __init__(self, own: Own, sizes: np.ndarray):
        self.own, self.sizes = own, sizes
        self.centre = own.x.mean(0)
        self.sum = np.zeros((len(own.x), len(sizes)))

    def step(self, _ids, x, tag):
        order = np.argsort(tag, kind="stable")
        x, tag = x[order] - self.centre, tag[order]
        first = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
        for i, j, _, _ in self.own.pieces:
            d = np.sqrt(squares(self.own.x[i:j] - self.centre, x))
            self.sum[i:j, tag[first]] += np.add.reduceat(d, first, axis=1)

    def result(self):
        mine, row = self.own.tag, np.arange(len(self.own.x))
        n = self.sizes[mine]
        a = self.sum[row, mine] / np.maximum(n - 1, 1)
        mean = self.sum / self.sizes
        mean[row, mine] = _INF
        b = mean.min(1)
        top = np.maximum(a, b)
        s = np.where((n > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        yield pa.RecordBatch.from_pydict({"n": [len(s)], "s": [float(s.sum())], "q": [float((s * s).sum())]})


def silhouette_sums(df: DataFrame, folder, row_id: str, vector: str, cluster: str, rows: int | None = None) -> DataFrame:
    """(n, s, q) a task: rows, sum and sum of squares of their silhouettes; of all
    rows, or of about ``rows`` chosen by hash, each against all."""
    sizes = {r[0]: r[1] for r in df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster).count().orderBy(cluster).collect()}  # one row a cluster
    codes = {c: k for k, c in enumerate(sizes)}
    code = F.element_at(F.create_map(*[F.lit(z) for pair in codes.items() for z in pair]), F.col(cluster)) if codes else F.lit(None)
    n, size = sum(sizes.values()), np.array(list(sizes.values()), np.float64)
    coded = df.where(F.col(cluster).isNotNull()).withColumn("_code", code.cast("long"))
    blocks = blocked(coded, folder, row_id, vector, "_code", group_rows=max(PIECE_ROWS, min(GROUP_ROWS, SUMS_MOST // max(1, len(sizes)))))
    share = 1.0 if rows is None or rows >= n else rows / n
    own = "true" if share == 1.0 else f"pmod(xxhash64(id), 1000000) < {round(share * 1_000_000)}"
    return crossed(blocks, np.full(len(blocks.balls.block), _INF), lambda own: _Sums(own, size), lambda s, *a: s.step(*a), lambda s: s.result(), "n long, s double, q double", own)


__all__ = ["blocked", "crossed", "density_clusters", "in_folder", "nearest", "silhouette_sums"]
