"""Average-linkage order: of entities at any number by their links, and of a bounded set for matrices that people look at."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

#: More entities than a picture can show are refused.
MOST = 2000
#: Similarities count as whole multiples of its reciprocal, so sums are exact and ties are ties.
UNITS = 10**12


def linkage_leaves(count: int, links: Iterable[tuple[int, int, float]]) -> list[int]:
    """The leaves of the average-linkage tree over ``1 - similarity`` of the entities 0 to ``count - 1``, left to right.
    Missing pairs are unlike (0); ties go to the pair that comes first; of two branches the one with the smaller entity
    is left.

    Branches that are each other's nearest are merged at once, whatever else is nearer elsewhere: the tree is the same,
    since no merge brings a third branch nearer, ties included. Only links are held, never a matrix; a branch takes over
    the links of the one with fewer, so the work is near the number of links. What no link joins stands side by side.
    """
    near: list[dict[int, int]] = [{} for _ in range(count)]
    for a, b, s in links:
        w = round(min(1.0, s) * UNITS)
        if a != b and w > 0:
            near[a][b] = near[b][a] = w
    size, first, last, after = [1] * count, list(range(count)), list(range(count)), [-1] * count

    def entry(a: int, b: int) -> tuple[int, int, int]:
        """Sorts b among a's neighbours, the nearest first. Means of up to 2**32 entities a side are told apart."""
        return -((near[a][b] << 64) // size[b]), first[b], b

    told = [[entry(a, b) for b in own] for a, own in enumerate(near)]
    for own in told:
        heapq.heapify(own)

    def nearest(a: int) -> int:
        own = told[a]
        while True:  # an entry may be too near, since its branch has grown, but never too far
            b = own[0][2]
            if b not in near[a]:
                heapq.heappop(own)
            elif own[0] != (now := entry(a, b)):
                heapq.heapreplace(own, now)
            else:
                return b

    def merge(a: int, b: int) -> int:
        if len(near[a]) < len(near[b]):
            a, b = b, a
        del near[a][b], near[b][a]
        left, right = (a, b) if first[a] < first[b] else (b, a)
        after[last[left]] = first[right]
        size[a], first[a], last[a] = size[a] + size[b], first[left], last[right]
        for c, w in near[b].items():
            del near[c][b]
            near[a][c] = near[c][a] = near[a].get(c, 0) + w
            heapq.heappush(told[a], entry(a, c))
            heapq.heappush(told[c], entry(c, a))
        near[b], told[b] = {}, []
        return a

    roots, over = [], [False] * count
    for start in range(count):
        chain = [] if over[start] else [start]
        while chain:
            a = chain[-1]
            if not near[a]:
                roots.append(first[a])
                over[a] = True
                break
            b = nearest(a)
            if len(chain) > 1 and chain[-2] == b:
                del chain[-2:]
                kept = merge(a, b)
                over[a] = over[b] = True
                over[kept] = False
                chain = chain or [kept]
            else:
                chain.append(b)
    order = []
    for at in sorted(roots):
        while at >= 0:
            order.append(at)
            at = after[at]
    return order


def average_linkage_order(names: list[str], similarity: dict[tuple[str, str], float]) -> list[str]:
    """``linkage_leaves`` of names in their order, for as many as a picture can show."""
    if len(names) > MOST:
        raise ValueError(f"at most {MOST} entities can be ordered")
    names = sorted(names)
    place = {n: i for i, n in enumerate(names)}
    return [names[i] for i in linkage_leaves(len(names), ((place[a], place[b], s) for (a, b), s in similarity.items() if a in place and b in place))]
