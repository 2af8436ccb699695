"""The k most similar vectors of every vector: a hierarchical k-means tree, rows held and asked for in several near leaves, calibrated recall."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidsift.session import cut, parallelism, spread

#: Vectors the tree is fitted on: TREE_SAMPLE, or one in TREE_SHARE where the table is large, up to TREE_MOST; vectors the
#: numbers of leaves are calibrated on, at most.
TREE_SAMPLE, TREE_SHARE, TREE_MOST = 32_768, 8, 262_144
CALIBRATION_SAMPLE = 384
#: Children of a node; rows that a leaf should hold; vectors that a shard (one task's share of the index) holds at most.
BRANCHES = 64
LEAF_ROWS = 256
SHARD_ROWS = 65_536
#: Queries that a task should answer.
TASK_QUERIES = 100_000
#: Nodes that stay open at each level on the way to the leaves, at first; leaves that hold a row, at most; comparisons that sending a row to a shard is worth.
BEAM, HOLDS, SENT_WORTH = 40, 16, 2_000
TARGET_RECALL = 0.995
DECIMALS = 6
#: Candidates beyond k that single precision hands over to double precision; where it can't tell them from more, all are compared in double.
SPARE = 4


@dataclass
class Tree:
    """Nodes as arrays: unit centroids, the first child and number of children, and the leaf's number or -1. Node 0 is the root."""

    centroid: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def near(self, u: np.ndarray, width: int) -> np.ndarray:
        """The `width` nearest leaves of each unit row, nearest first, -1 where there are fewer: at each level the `width` nearest nodes stay open."""
        width = min(width, self.leaves)
        step = max(1, (1 << 23) // (width * min(width, max(int(self.children.max()), 1))))
        return np.concatenate([np.zeros((0, width), np.int32), *(self._near(u[at : at + step], width) for at in range(0, len(u), step))])

    def _near(self, u: np.ndarray, width: int) -> np.ndarray:
        node, sim = np.zeros((len(u), 1), np.int32), np.ones((len(u), 1), np.float32)
        while (inner := (node >= 0) & (self.leaf[node] < 0)).any():
            row, slot = np.nonzero(inner)
            order = np.argsort(node[row, slot], kind="stable")
            row, slot = row[order], slot[order]
            open_ = node[row, slot]
            each = min(width, int(self.children[open_].max()))
            sims = np.full((*node.shape, each), -2.0, np.float32)
            nodes = np.full((*node.shape, each), -1, np.int32)
            sims[:, :, 0], nodes[:, :, 0] = np.where(inner, -2.0, sim), np.where(inner, -1, node)
            edges = np.flatnonzero(np.diff(open_)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(open_)]):
                first, many = int(self.child[open_[a]]), int(self.children[open_[a]])
                s = u[row[a:b]] @ self.centroid[first : first + many].T
                if many > each:
                    top = np.argpartition(s, many - each, axis=1)[:, many - each :]
                    s = np.take_along_axis(s, top, 1)
                else:
                    top = np.arange(many)
                sims[row[a:b], slot[a:b], : s.shape[1]] = s
                nodes[row[a:b], slot[a:b], : s.shape[1]] = top + first
            sim, node = sims.reshape(len(u), -1), nodes.reshape(len(u), -1)
            if sim.shape[1] > width:
                top = np.argpartition(sim, sim.shape[1] - width, axis=1)[:, sim.shape[1] - width :]
                sim, node = np.take_along_axis(sim, top, 1), np.take_along_axis(node, top, 1)
        node = np.take_along_axis(node, np.argsort(-sim, axis=1, kind="stable"), 1)
        out = np.full((len(u), width), -1, np.int32)
        out[:, : node.shape[1]] = np.where(node >= 0, self.leaf[node], -1)
        return out


def _kmeans(u: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    c = u[rng.choice(len(u), k, replace=False)].copy()
    near = np.zeros(len(u), dtype=np.int64)
    for at_round in range(rounds + 1):
        total = np.zeros_like(c)
        # by slices, so that only the sample itself is held whole
        for at in range(0, len(u), 32_768):
            part = u[at : at + 32_768]
            own = near[at : at + 32_768] = (part @ c.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            there, starts = np.unique(own[order], return_index=True)
            total[there] += np.add.reduceat(part[order], starts, axis=0)
        if at_round == rounds:
            return c, near
        empty = np.bincount(near, minlength=k) == 0
        total[empty] = u[rng.choice(len(u), int(empty.sum()))]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(u.dtype)


def fit_tree(u: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES) -> Tree:
    """Hierarchical k-means over the sampled unit rows u, of `rows` in all: a node splits while it stands for more than leaf_rows rows."""
    rng = np.random.default_rng(7)
    centroid, child, children = [u.mean(axis=0) if len(u) else np.zeros(u.shape[1], u.dtype)], [0], [0]
    scale = rows / max(len(u), 1)
    todo = [(0, np.arange(len(u)))]
    while todo:
        node, own = todo.pop(0)
        k = min(branches, int(np.ceil(len(own) * scale / leaf_rows)), len(own) // 4)
        if k < 2:
            continue
        c, near = _kmeans(u if len(own) == len(u) else u[own], k, rng)
        child[node], children[node] = len(centroid), k
        for i in range(k):
            todo.append((len(centroid), own[near == i]))
            centroid.append(c[i])
            child.append(0)
            children.append(0)
    n = np.array(children, dtype=np.int32)
    leaf = np.full(len(n), -1, dtype=np.int32)
    # leaves are numbered depth first, so that near leaves have near numbers
    stack, number = [0], 0
    while stack:
        node = stack.pop()
        if n[node] == 0:
            leaf[node], number = number, number + 1
        else:
            stack += list(range(child[node] + n[node] - 1, child[node] - 1, -1))
    return Tree(np.stack(centroid).astype(np.float32), np.array(child, dtype=np.int32), n, leaf)


def _unit(blobs: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of vectors (stored in the precision they came in), in double and in single precision."""
    raw = b"".join(blobs.to_pylist())
    kind = np.float32 if len(raw) == len(blobs) * dims * 4 else np.float64
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, dims)
    # by the largest value first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, x.astype(np.float32)


def _usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the rows with `dims` finite values that aren't all zero."""
    ids, lists = batch.column(0), batch.column(1)
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    keep = (length == dims) & ids.is_valid().to_numpy(zero_copy_only=False)
    lists, ids = lists.filter(pa.array(keep)), ids.filter(pa.array(keep))
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = x if x.dtype == np.float32 else x.astype(np.float64)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.to_numpy(zero_copy_only=False)[ok].astype(np.int64), x[ok] + x.dtype.type(0)


def _digests(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]


def _combined(dims: int, most: int):
    """Rows to classes of equal vectors, within each batch: digest, vector, count, the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _usable(batch, dims)
            at: dict[bytes, list] = {}
            for i, (vid, d) in enumerate(zip(ids.tolist(), _digests(x))):
                at.setdefault(d, [i, []])[1].append(vid)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(at), pa.binary()),
                        pa.array([x[i].tobytes() for i, _ in at.values()], pa.binary()),
                        pa.array([len(v) for _, v in at.values()], pa.int64()),
                        pa.array([sorted(v)[:most] for _, v in at.values()], pa.list_(pa.int64())),
                    ],
                    ["h", "v", "n", "ids"],
                )

    return run


def _members(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _usable(batch, dims)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_digests(x), pa.binary())], ["id", "h"])

    return run


def _halved(dims: int):
    """Unit rows in half precision: enough to fit the tree on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _unit(batch.column(0), dims)[1].astype(np.float16)], pa.binary())], ["u"])

    return run


def _exact(queries_b, dims: int, k: int):
    """Brute force for the calibration queries: the k best vectors of each over one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = queries_b.value
        sims = np.full((len(q), k), -2.0, dtype=np.float32)
        reps = np.zeros((len(q), k), dtype=np.int64)
        for batch in batches:
            _, u = _unit(batch.column(0), dims)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            s = q @ u.T
            s[own[:, None] == rep[None, :]] = -2.0
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(q), 1))
            s2 = np.concatenate([sims, np.take_along_axis(s, best, 1)], axis=1)
            r2 = np.concatenate([reps, rep[best]], axis=1)
            top = np.argsort(-s2, axis=1)[:, :k]
            sims, reps = np.take_along_axis(s2, top, 1), np.take_along_axis(r2, top, 1)
        ok = sims > -2.0
        no = np.repeat(np.arange(len(q)), k).reshape(len(q), k)
        yield pa.RecordBatch.from_arrays([pa.array(no[ok], pa.int64()), pa.array(sims[ok].astype(np.float64)), pa.array(reps[ok])], ["q", "s", "rep"])

    return run


def _leaves_needed(asked: np.ndarray, near: np.ndarray, owner: np.ndarray, target: float, rows: int, leaves: int, shard_rows: int) -> tuple[int, int] | None:
    """In how many of its nearest leaves a row is held, and in how many it asks, so that `target` of the true neighbours meet: the
    cheapest of all pairs of numbers, None if these lists are too short. asked: the nearest leaves of queries; near: those of
    their true neighbours, of which owner says whose they are."""
    width, most = asked.shape[1], min(HOLDS, asked.shape[1])
    first = np.full((len(near), most), width)
    for at in range(0, len(near), 64):
        there = near[at : at + 64, None, :most]
        same = (asked[owner[at : at + 64], :, None] == there) & (there >= 0)
        first[at : at + 64] = np.minimum.accumulate(np.where(same.any(axis=1), same.argmax(axis=1), width), axis=1)
    asks = np.sort(first, axis=0)[min(len(near) - 1, int(np.ceil(target * len(near))) - 1)] + 1
    holds = np.arange(1, most + 1)
    sent = np.minimum(np.maximum(holds, asks), 1 + holds * rows / shard_rows)
    cost = np.where(asks > width, np.inf, holds * asks * (rows / leaves) + SENT_WORTH * sent)
    best = int(cost.argmin())
    return (int(holds[best]), int(asks[best])) if np.isfinite(cost[best]) else None


@dataclass
class Plan:
    """By leaf its first shard and over how many it is dealt; by shard its replicas and the number of its first task."""

    first: np.ndarray
    chunks: np.ndarray
    replicas: np.ndarray
    base: np.ndarray
    sent: float

    @staticmethod
    def packed(sizes: list[int], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves into shards of `limit` rows at most, in order, so that near leaves share one."""
        first, chunks, filled, shard = [], [], 0, 0
        for n in sizes:
            if filled and filled + n > limit:
                shard, filled = shard + 1, 0
            first.append(shard)
            chunks.append(n // limit + 1 if n > limit else 1)
            shard, filled = shard + chunks[-1] - 1, filled + n // chunks[-1]
        return np.array(first), np.array(chunks)

    @classmethod
    def least(cls, sizes: np.ndarray, lists: np.ndarray, holds: int, asks: int, rows: int, tasks: int, most: int, leaf_rows: int) -> Plan:
        """Of several shard sizes the one that sends the fewest vectors: a row to each shard that has one of its leaves, by
        what the calibration queries' `lists` of leaves show, and to each replica of those that hold it. Replicas follow the
        work of a shard, so that all tasks have their share."""
        held, asked = sizes * holds, np.minimum(sizes * asks, rows)
        best = None
        limit = most * holds
        while limit >= leaf_rows or best is None:
            first, chunks = cls.packed(held.tolist(), limit)
            shards = int(first[-1] + chunks[-1])

            def places(n: int) -> float:
                """Shards that a row has leaves in, its n nearest, on average."""
                seen = [set().union(*(range(first[x], first[x] + chunks[x]) for x in own if x >= 0)) for own in lists[:, :n].tolist()]
                return sum(map(len, seen)) / max(len(seen), 1) or 1.0

            held_in, asked_in, work = np.zeros(shards), np.zeros(shards), np.zeros(shards)
            for leaf, (at, many) in enumerate(zip(first.tolist(), chunks.tolist())):
                held_in[at : at + many] += held[leaf] / many
                asked_in[at : at + many] += asked[leaf]
                work[at : at + many] += asked[leaf] * held[leaf] / many
            # the leaves of a row partly share a shard, and there it is one row
            held_in *= rows * min(places(holds), shards) / max(held_in.sum(), 1.0)
            asked_in = np.minimum(asked_in * rows * places(asks) / max(asked_in.sum(), 1.0), rows)
            share = work / max(work.sum(), 1.0) * tasks
            replicas = np.maximum(np.maximum(np.rint(share), 1), asked_in // TASK_QUERIES + 1).astype(int)
            sent = float(rows * places(max(holds, asks)) + (held_in * (replicas - 1)).sum())
            if (best is None or sent < best.sent) and (held_in.mean() <= most or limit // 2 < leaf_rows):
                best = cls(first, chunks, replicas, np.concatenate([[0], np.cumsum(replicas)]), sent)
            limit //= 2
        return best


#: Marks of a row's leaf: the row is held there, it asks there.
HELD, ASKS = 1, 2


def _placed(tree_b, plan_b, dims: int, width: int, holds: int, asks: int):
    """Each class to the shards that have one of its leaves, with those leaves and their marks: as a row of the index (kind 0), which
    mostly asks too, or only as a query (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, plan = tree_b.value, plan_b.value
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                _, u = _unit(batch.column("v"), dims)
                digest = np.frombuffer(b"".join(h[:8] for h in batch.column("h").to_pylist()), dtype=np.uint64)
                near = tree.near(u, width)[:, : max(holds, asks)]
                row, nth = np.nonzero(near >= 0)
                leaf, hold, ask = near[row, nth], nth < holds, nth < asks
                # a leaf that is dealt out holds the row in one of its shards, and is asked in all
                many = plan.chunks[leaf]
                chunk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, leaf, hold, ask = (np.repeat(x, many) for x in (row, leaf, hold, ask))
                hold &= chunk == (digest[row] % plan.chunks[leaf].astype(np.uint64)).astype(np.int64)
                shard = plan.first[leaf] + chunk
                # every replica holds the row, one is asked
                asked = ((digest[row] >> np.uint64(20)) % plan.replicas[shard].astype(np.uint64)).astype(np.int64)
                many = np.where(hold, plan.replicas[shard], 1)
                replica = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, leaf, hold, ask, shard, asked = (np.repeat(x, many) for x in (row, leaf, hold, ask, shard, asked))
                replica = np.where(hold, replica, asked)
                ask &= replica == asked
                keep = np.flatnonzero(hold | ask)
                row, place, mark = row[keep], (plan.base[shard] + replica)[keep], (leaf.astype(np.int64) * 4 + HELD * hold + ASKS * ask)[keep]
                order = np.lexsort((place, row))
                row, place, mark = row[order], place[order], mark[order]
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(place) != 0)])) if len(row) else np.zeros(0, dtype=np.int64)
                kind = 1 - np.bitwise_or.reduceat(mark & HELD, starts) if len(row) else starts
                marks = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(row)], pa.int32()), pa.array(mark))
                take = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[starts], pa.int32()), pa.array(kind, pa.int32()), marks, batch.column("v").take(take), batch.column("rep").take(take), batch.column("ids").take(take)],
                    ["place", "kind", "leaves", "v", "rep", "ids"],
                )

    return run


def _marks(t: pa.Table, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves that have the mark, leaf by leaf, the rows of each rising."""
    lists = t["leaves"].combine_chunks()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    value = lists.flatten().to_numpy()
    row, leaf = row[value & mark > 0], value[value & mark > 0] >> 2
    order = np.argsort(leaf, kind="stable")
    return row[order], leaf[order]


def _groups(row: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with its rows."""
    edges = np.flatnonzero(np.diff(leaf)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(leaf)]):
        if a < b:
            yield int(leaf[a]), row[a:b]


class _Shard:
    """The index rows of one task, by leaf, and the search of query batches over them."""

    def __init__(self, tables: list[pa.Table], dims: int, k: int) -> None:
        t = pa.concat_tables(tables).combine_chunks()
        t = t.take(pa.array(np.argsort(t["rep"].to_numpy(), kind="stable")))
        self.rows, self.k, self.dims = t, k, dims
        self.exact, self.u = _unit(t["v"].combine_chunks(), dims)
        # rising, so a smaller place is a smaller id
        self.rep = t["rep"].to_numpy()
        lists = t["ids"].combine_chunks()
        n = pc.list_value_length(lists).to_numpy()
        self.ids = np.full((len(n), k + 1), np.iinfo(np.int64).max)
        self.ids[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
        self.held = dict(_groups(*_marks(t, HELD)))

    def _itself(self, rep: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the queries are among the held rows, and where."""
        at = np.minimum(np.searchsorted(self.rep[held], rep), len(held) - 1)
        there = np.flatnonzero(self.rep[held][at] == rep)
        return there, at[there]

    def answer(self, batch: pa.Table) -> pa.RecordBatch:
        """rep, sims, ids of each query: its k + 1 best ids here, by similarity to six decimals, then the smaller id."""
        row, leaf = _marks(batch, ASKS)
        asking, row = np.unique(row, return_inverse=True)
        batch = batch.take(pa.array(asking))
        exact, u = _unit(batch["v"].combine_chunks(), self.dims)
        rep, k = batch["rep"].to_numpy(), self.k
        wide = k + 1 + SPARE
        best = np.full((len(u), wide), -2.0, dtype=np.float32)
        which = np.full((len(u), wide), -1)
        for x, rows in _groups(row, leaf):
            held = self.held.get(x, row[:0])
            for c in range(0, len(held), 8192):
                part = held[c : c + 8192]
                near = self.u[part].T
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    s = u[own] @ near
                    s[self._itself(rep[own], part)] = -2.0
                    if len(part) > wide:
                        top = np.argpartition(s, len(part) - wide, axis=1)[:, len(part) - wide :]
                        s = np.take_along_axis(s, top, 1)
                        top = part[top]
                    else:
                        top = np.broadcast_to(part, s.shape)
                    # another of the query's leaves may hold the same row
                    s[(top[:, :, None] == which[own][:, None, :]).any(axis=2)] = -2.0
                    s2, w2 = np.concatenate([best[own], s], axis=1), np.concatenate([which[own], np.where(s > -2.0, top, -1)], axis=1)
                    keep = np.argpartition(s2, s2.shape[1] - wide, axis=1)[:, s2.shape[1] - wide :]
                    best[own], which[own] = np.take_along_axis(s2, keep, 1), np.take_along_axis(w2, keep, 1)
        # more rows than fit may tie with the (k + 1)-th at DECIMALS, within the error of single precision
        margin = 10.0**-DECIMALS + 2 * (self.dims + 2) * 2.0**-24
        ordered = np.sort(best, axis=1)
        unclear = (ordered[:, 0] > -2.0) & (ordered[:, 0] >= ordered[:, -(k + 1)] - margin)
        if unclear.any():
            some = unclear[row]
            best[unclear], which[unclear] = self._in_double(exact[unclear], rep[unclear], (np.cumsum(unclear) - 1)[row[some]], leaf[some], wide)
        sims = np.empty((len(u), wide))
        for at in range(0, len(u), 1024):
            sims[at : at + 1024] = np.einsum("qd,qcd->qc", exact[at : at + 1024], self.exact[np.maximum(which[at : at + 1024], 0)])
        sims = np.where(best > -2.0, np.round(sims, DECIMALS), -2.0)
        ids = self.ids[np.maximum(which, 0)].reshape(len(u), wide * (k + 1))
        flat = np.repeat(sims, k + 1, axis=1)
        flat = np.where(ids == np.iinfo(np.int64).max, -2.0, flat)
        order = np.lexsort((ids, -flat), axis=1)[:, : k + 1]
        flat, ids = np.take_along_axis(flat, order, 1), np.take_along_axis(ids, order, 1)
        count = (flat > -2.0).sum(axis=1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        ok = flat > -2.0
        return pa.RecordBatch.from_arrays(
            [pa.array(rep), pa.ListArray.from_arrays(offsets, pa.array(flat[ok])), pa.ListArray.from_arrays(offsets, pa.array(ids[ok]))], ["rep", "sims", "ids"]
        )

    def _in_double(self, exact: np.ndarray, rep: np.ndarray, row: np.ndarray, leaf: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The `wide` best index rows of each query, by similarity in double precision to DECIMALS, then the smaller id.

        A row has ids of its own, the smallest of them first, so k + 1 rows in this order hold the k + 1 best ids.
        """
        unit, none = 10**DECIMALS, np.iinfo(np.int64).max
        # one number orders rows: similarity falling, then id rising, by the row's place in the shard
        best = np.full((len(exact), wide), none)
        for x, rows in _groups(row, leaf):
            held = self.held.get(x, row[:0])
            for c in range(0, len(held), 8192):
                part = held[c : c + 8192]
                for at in range(0, len(rows), 512):
                    own = rows[at : at + 512]
                    key = (unit - np.rint((exact[own] @ self.exact[part].T) * unit).astype(np.int64) << 32) + part
                    key[self._itself(rep[own], part)] = none
                    if len(part) > wide:
                        key = np.partition(key, wide - 1, axis=1)[:, :wide]
                    # the same row from another leaf has nearly the same key, and is one row
                    key[((key[:, :, None] & (2**32 - 1)) == (best[own][:, None, :] & (2**32 - 1))).any(axis=2)] = none
                    best[own] = np.partition(np.concatenate([best[own], key], axis=1), wide - 1, axis=1)[:, :wide]
        return np.where(best == none, -2.0, 1.0).astype(np.float32), np.where(best == none, -1, best & (2**32 - 1))


def _searched(dims: int, k: int):
    """Sorted by shard, index rows before queries: a shard is held whole, its own rows ask, then queries stream past in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, shard = None, [], None

        def answers(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, t.num_rows, 8192):
                yield shard.answer(t.slice(at, 8192))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            places, kinds = t["place"].to_numpy(), t["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(places)]):
                if a == b:
                    continue
                if rows and (places[a] != place or kinds[a]):
                    shard, rows = _Shard(rows, dims, k), []
                    yield from answers(shard.rows)
                if places[a] != place:
                    place, shard = places[a], None
                part = t.slice(a, b - a)
                if kinds[a] == 0:
                    rows.append(part)
                elif shard is not None:
                    yield from answers(part)
        if rows:
            shard = _Shard(rows, dims, k)
            yield from answers(shard.rows)

    return run


def nearest_vectors(
    df: DataFrame,
    *,
    vec_id: str,
    vector: str,
    dims: int = 128,
    k: int = 5,
    target: float = TARGET_RECALL,
    leaf_rows: int = LEAF_ROWS,
    shard_rows: int = SHARD_ROWS,
    tree_sample: int | None = None,
) -> DataFrame:
    """vec_id, neighbour_id (long), similarity (double, 6 decimals), neighbour_rank (int, from 1): k rows per usable vector.

    Usable is a vector with exactly `dims` values, all finite, not all zero; others (null ones too) neither ask nor
    answer. Most similar: cosine in double precision rounded to 6 decimals, then the smaller vec_id; equal vectors
    under other ids count. Fewer rows only where fewer than k other usable vectors exist; an empty table gives none.
    vec_id must be unique. Other columns are ignored. Every row is indexed and asks; only the tree is fitted on a
    bounded sample (`tree_sample`; by default it follows the number of rows, up to TREE_MOST). A row is held in several of
    its nearest leaves and asks in several: two rows meet in any leaf that they share, so few are needed. How many is calibrated
    on CALIBRATION_SAMPLE vectors against brute force over all rows: the cheapest numbers that reach `target` recall.

    Equal vectors are one entry of the index with their k + 1 smallest ids, so masses of copies cost nothing. Leaves
    lie in shards of near leaves; a leaf too large for one shard is dealt over several by hash, all of which are asked.
    A row goes once to each shard that has leaves of it, and a shard with much work is replicated. How large
    shards are is chosen by the number of vectors that would be sent, as the calibration queries show it.
    """
    spark = df.sparkSession
    slim = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    combined = slim.mapInArrow(_combined(dims, k + 1), "h binary, v binary, n long, ids array<long>")
    # one exchange, combined before it, over as many parts as the searches below can use
    classes = combined.repartition(2 * parallelism(spark), "h").groupBy("h").agg(F.any_value("v").alias("v"), F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    classes = cut(classes.withColumn("rep", F.element_at("ids", 1)))
    rows = classes.count()

    tree_sample = tree_sample or min(TREE_MOST, max(TREE_SAMPLE, rows // TREE_SHARE))
    pick = lambda share, seed: classes.filter(F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)) + 1)
    sample = pick(tree_sample / max(rows, 1), 1).select("v").limit(tree_sample).mapInArrow(_halved(dims), "u binary").toArrow()
    tree = fit_tree(np.frombuffer(b"".join(x for c in sample["u"].chunks for x in c.to_pylist()), np.float16).astype(np.float32).reshape(-1, dims), rows, leaf_rows)
    del sample
    asked = pick(CALIBRATION_SAMPLE / max(rows, 1), 2).select("v", "rep").limit(CALIBRATION_SAMPLE).toArrow()
    q = _unit(asked["v"].combine_chunks(), dims)[1]
    tree_b = spark.sparkContext.broadcast(tree)
    queries_b = spark.sparkContext.broadcast((q, asked["rep"].to_numpy()))
    width, holds, asks = tree.leaves, 1, tree.leaves
    if len(q) and tree.leaves > 1:
        found = classes.select("v", "rep").mapInArrow(_exact(queries_b, dims, k), "q long, s double, rep long")
        best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "rep")), asc=False), 1, k).alias("best")).select("q", F.explode("best.rep").alias("rep")).toArrow()
        wanted = spark.createDataFrame([(x,) for x in set(best["rep"].to_pylist())], "rep long")
        there = classes.select("v", "rep").join(F.broadcast(wanted), "rep").select("rep", "v").toArrow()
        at = {x: i for i, x in enumerate(there["rep"].to_pylist())}
        to = np.array([at[x] for x in best["rep"].to_pylist()], dtype=np.int64)
        answers_u, need, width = _unit(there["v"].combine_chunks(), dims)[1], None, BEAM
        while need is None and len(to):
            width = min(width, tree.leaves)
            need = _leaves_needed(tree.near(q, width), tree.near(answers_u, width)[to], best["q"].to_numpy(), target, rows, tree.leaves, shard_rows)
            if need is None:
                width *= 4
        holds, asks = need or (holds, asks)

    sizes = np.zeros(tree.leaves, dtype=np.int64)
    leaf_of = lambda batches: (pa.RecordBatch.from_arrays([pa.array(tree_b.value.near(_unit(b.column(0), dims)[1], 1)[:, 0])], ["leaf"]) for b in batches)
    for r in classes.select("v").mapInArrow(leaf_of, "leaf int").groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    plan = Plan.least(sizes, tree.near(q, width), holds, asks, rows, parallelism(spark), shard_rows, leaf_rows)
    plan_b = spark.sparkContext.broadcast(plan)

    ddl = "place int, kind int, leaves array<long>, v binary, rep long, ids array<long>"
    placed = spread(classes).mapInArrow(_placed(tree_b, plan_b, dims, width, holds, asks), ddl)
    placed = placed.repartitionById(max(int(plan.base[-1]), 1), F.col("place")).sortWithinPartitions("place", "kind")
    answers = placed.mapInArrow(_searched(dims, k), "rep long, sims array<double>, ids array<long>")
    # own copies first: they're as similar as can be, and the vector itself is taken out below
    own = classes.select("rep", F.transform("ids", lambda x: F.lit(1.0)).alias("sims"), "ids", "n")
    merged = (
        answers.withColumn("n", F.lit(0).cast("long"))
        .unionByName(own)
        .groupBy("rep")
        .agg(F.flatten(F.collect_list(F.transform(F.arrays_zip("sims", "ids"), lambda c: F.struct((-c["sims"]).alias("s"), c["ids"].alias("id"))))).alias("c"), F.max("n").alias("n"))
        .select("rep", "n", F.slice(F.sort_array(F.array_distinct("c")), 1, 2 * (k + 1)).alias("c"))
    )
    # shards agree about a pair that they share, but for a last digit perhaps: the first counts
    once = F.filter("c", lambda c, i: F.array_position("c.id", c["id"]) == i + 1)
    merged = merged.select("rep", "n", F.slice(F.when(F.size(F.array_distinct("c.id")) == F.size("c"), F.col("c")).otherwise(once), 1, k + 1).alias("c"))
    merged = cut(merged)
    several = classes.filter("n > 1").select("h", "rep")
    copies = slim.mapInArrow(_members(dims), "id long, h binary").join(several, "h").join(merged.drop("n"), "rep").select("id", "c")
    near = merged.filter("n = 1").select(F.col("rep").alias("id"), "c").unionByName(copies).select("id", F.slice(F.filter("c", lambda c: c["id"] != F.col("id")), 1, k).alias("c"))
    return near.select("id", F.posexplode("c").alias("at", "c")).select(
        F.col("id").alias(vec_id), F.col("c.id").alias("neighbour_id"), (-F.col("c.s")).alias("similarity"), (F.col("at") + 1).cast("int").alias("neighbour_rank")
    )


def neighbour_pairs(near: DataFrame, vec_id: str) -> DataFrame:
    """vec_id_a < vec_id_b: each pair of which one is among the nearest of the other, once."""
    return near.select(F.least(vec_id, "neighbour_id").alias("vec_id_a"), F.greatest(vec_id, "neighbour_id").alias("vec_id_b")).distinct()
