"""Exact similarity of weighted sets: one pair at a time, or one set with many hubs.

A set is its sorted values as 64-bit integers, and its weights as doubles, null where all
are 1. Similarity is probability Jaccard, which is plain Jaccard where all weights are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packetscope.llm.common import give_back
from packetscope.llm.shingles import mixed

# sets of a bucket that all meet; in larger ones only those that share a value of their prefixes
CROWDED = 64


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two weighted sets, given as sorted values with weights.

    The sum over common d of 1 / sum over e of max(wa[e] / wa[d], wb[e] / wb[d]). For each
    d the inner sum splits at the ratio wa[e] / wb[e] = wa[d] / wb[d].
    """
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    alone_a, alone_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    xa, xb = wa[ia], wb[ib]
    ratio = xa / xb
    order = np.argsort(ratio, kind="stable")
    xa, xb, ratio = xa[order], xb[order], ratio[order]
    below = np.searchsorted(ratio, ratio, side="right")  # wa[e]/wa[d] is the smaller there
    cum_a, cum_b = np.append(0, np.cumsum(xa)), np.append(0, np.cumsum(xb))
    most = (alone_a + cum_a[-1] - cum_a[below]) / xa + (alone_b + cum_b[below]) / xb
    return float((1 / most).sum())


def _values(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint64)


def _weights(body: bytes | None, size: int) -> np.ndarray:
    return np.ones(size) if body is None else np.frombuffer(body)


def _enough(common, size, other, least: float):
    """Whether plain Jaccard reaches ``least``, in whole numbers: exactly the least counts."""
    return common * 1000 >= round(least * 1000) * (size + other - common)


def alike(x: dict, y: dict, least: float) -> bool:
    """Whether two bodies are at least so similar."""
    a, b = _values(x["values"]), _values(y["values"])
    if x["weights"] is None and y["weights"] is None:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return bool(_enough(common, len(a), len(b), least))
    return probability_jaccard(a, _weights(x["weights"], len(a)), b, _weights(y["weights"], len(b))) >= least


def prefix_of(sizes, share: int):
    """How many first values of a set, in any order that all sets keep, two sets that are similar
    by ``share`` thousandths must meet in."""
    return sizes - -(-share * sizes // 1000) + 1


def _apart(bucket: np.ndarray, sizes: np.ndarray, values: np.ndarray, share: int):
    """``bucket, number, room`` of sets, with crowded buckets cut by the values of sets' prefixes.

    Values come rare ones first. Of two similar sets the first value in common lies in both
    prefixes, and no more values are common than follow it in either: its ``room``.
    """
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    number = np.diff(np.append(first, len(bucket)))
    crowded = np.repeat(number > CROWDED, number)
    many, few = np.flatnonzero(crowded), np.flatnonzero(~crowded)
    if not len(many):
        return bucket, few, sizes
    size = sizes[many]
    of = np.repeat(np.arange(len(many)), size)
    code = values[np.repeat(crowded, sizes)] + np.repeat(mixed(bucket[many].astype(np.uint64)), size)
    _, rank, times = np.unique(code, return_inverse=True, return_counts=True)
    order = np.lexsort((rank, times[rank], of))
    rank, place = rank[order], np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    take = np.flatnonzero((place < prefix_of(size, share)[of]) & (times[rank] > 1))
    take = take[np.bincount(rank[take])[rank[take]] > 1] if len(take) else take
    bucket = np.concatenate([bucket[few], mixed(code[order][take]).view(np.int64)])
    number = np.concatenate([few, many[of[take]]])
    room = np.concatenate([sizes[few], (size[of] - place)[take]])
    order = np.argsort(bucket, kind="stable")
    return bucket[order], number[order], room[order]


def links_within(
    bucket: np.ndarray, sizes: np.ndarray, values: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of plain sets, by number, whose links connect what is similar in each bucket.

    ``bucket`` is sorted; ``values`` are those of all sets one after the other. In each step
    a set of a smallest class of every bucket meets the others that are not in its class,
    and is done. Steps go on until the sets left in a bucket are in one class. Of a crowded
    bucket only sets meet that have a value of their prefixes in common, as similar ones do.
    """
    share = round(least * 1000)
    starts = np.cumsum(sizes) - sizes
    label, out = np.arange(len(sizes)), []
    bucket, number, room = _apart(bucket, sizes, values, share)
    size, left = sizes[number], np.arange(len(bucket))
    # equal values of different buckets differ
    tag = mixed(bucket.astype(np.uint64))

    def codes(members):
        of = size[members]
        at = np.repeat(starts[number[members]] - np.cumsum(of) + of, of) + np.arange(of.sum())
        return values[at] + np.repeat(tag[members], of)

    while len(left):
        first = np.flatnonzero(np.append(True, np.diff(bucket[left]) != 0))
        many = np.diff(np.append(first, len(left)))
        own = label[number[left]]
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        left, own, many = left[np.repeat(several, many)], own[np.repeat(several, many)], many[several]
        if not len(left):
            break
        first = np.cumsum(many) - many
        order = np.bincount(own)[own] * len(left) + np.arange(len(left))
        place = np.minimum.reduceat(order, first) % len(left)
        hub = np.repeat(left[place], many)
        # what the first common value leaves room for must be enough
        meet = own != label[number[hub]]
        meet &= (1000 + share) * np.minimum(room[left], room[hub]) >= share * (size[left] + size[hub])
        x, y = left[meet], hub[meet]
        left = np.delete(left, place)
        if not len(x):
            continue
        theirs = np.sort(codes(y[np.append(True, y[1:] != y[:-1])]))
        mine = codes(x)
        same = theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
        common = np.add.reduceat(same, np.cumsum(size[x]) - size[x], dtype=np.int64)
        found = _enough(common, size[x], size[y], least)
        x, y = number[x[found]], number[y[found]]
        out.append((x, y))
        change = np.arange(len(label))
        change[label[x]] = label[y]
        label = change[label]
    x, y = (np.concatenate(side) for side in zip(*out)) if out else (left, left)
    return x, y


def roots_of(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers below ``n`` that each one is connected with by links ``x, y``."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def similar(least: float):
    """``alike`` as a column function of two bodies."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([alike(x.as_py(), y.as_py(), least) for x, y in zip(a, b)], pa.bool_())

        give_back()

    return F.arrow_udf(run, "boolean")


class Hubs:
    """Some sets, indexed by value, that others are compared with."""

    def __init__(self, rows: pa.Table):
        """``rows`` has ``root, buckets, values, weights``."""
        self.roots = rows.column("root").to_pylist()
        bodies = rows.select(["values", "weights"]).to_pylist()
        sets = [_values(b["values"]) for b in bodies]
        self.sizes = np.asarray([len(s) for s in sets], np.int64)
        self.plain = np.asarray([b["weights"] is None for b in bodies], bool)
        weights = [_weights(b["weights"], len(s)) for b, s in zip(bodies, sets)]
        self.totals = np.asarray([w.sum() for w in weights])
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.sets, self.weights = np.concatenate(sets), np.concatenate(weights)
        order = np.argsort(self.sets, kind="stable")
        self.sorted = self.sets[order]
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.by_value = self.weights[order]
        self.places: dict[int, list[int]] = {}
        for place, buckets in enumerate(rows.column("buckets").to_pylist()):
            for bucket in buckets:
                self.places.setdefault(bucket, []).append(place)

    def __call__(
        self, root: bytes, buckets: list[int], values: bytes, weights: bytes | None, least: float
    ) -> set[bytes]:
        """Classes of the hubs of these buckets, other than ``root``, that are similar."""
        near = {p for b in buckets for p in self.places.get(b, ()) if self.roots[p] != root}
        if not near:
            return set()
        near = np.fromiter(near, np.int64, len(near))
        a = _values(values)
        wa = _weights(weights, len(a))
        low, high = (np.searchsorted(self.sorted, a, side) for side in ("left", "right"))
        counts = high - low
        # the hubs' entries of all the values of ``a``, one run after the other
        runs = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owners = self.owners[runs]
        common = np.bincount(owners, minlength=len(self.sizes))[near]
        plain = self.plain[near] & (weights is None)
        found = plain & _enough(common, len(a), self.sizes[near], least)
        if not plain.all():
            # no similarity is above the common share of either side's weight
            mine = np.bincount(owners, np.repeat(wa, counts), len(self.sizes))[near] / wa.sum()
            theirs = np.bincount(owners, self.by_value[runs], len(self.sizes))[near] / self.totals[near]
            for i in np.flatnonzero(~plain & (np.minimum(mine, theirs) >= least - 1e-9)):
                part = slice(self.starts[near[i]], self.starts[near[i] + 1])
                found[i] = probability_jaccard(a, wa, self.sets[part], self.weights[part]) >= least
        return {self.roots[p] for p in near[found]}
