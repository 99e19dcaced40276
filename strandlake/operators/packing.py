"""Bin packing of taxa by their numbers of features: a driver step over one number a taxon."""

from __future__ import annotations

import heapq

Bin = list[tuple[str, int]]


def split(counts: dict[str, int], most: int) -> list[tuple[int, str]]:
    """Chunks of at most `most`, as even as can be, the largest first."""
    out = []
    for taxid, n in counts.items():
        parts = max(1, -(-n // most))
        size = -(-n // parts)
        out += [(min(size, n - i * size), taxid) for i in range(parts) if i == 0 or n > i * size]
    return sorted(out, key=lambda c: (-c[0], c[1]))


def assign(chunks: list[tuple[int, str]], bins: int, most_taxa: int) -> list[Bin]:
    """Each chunk to the lightest bin that has room and not the same taxon; a new bin if there is none."""
    out: list[Bin] = [[] for _ in range(bins)]
    heap = [(0, i) for i in range(bins)]
    for n, taxid in chunks:
        passed = []
        while heap and any(t == taxid for t, _ in out[heap[0][1]]):
            passed.append(heapq.heappop(heap))
        load, at = heapq.heappop(heap) if heap else (0, len(out))
        if at == len(out):
            out.append([])
        out[at].append((taxid, n))
        for x in passed + [(load + n, at)] * (len(out[at]) < most_taxa):
            heapq.heappush(heap, x)
    return [b for b in out if b]


def pack(counts: dict[str, int], most_taxa: int = 16) -> list[Bin]:
    """Bins of at most `most_taxa` taxa, of loads as even as found by halving the largest chunk up to six times."""
    if not counts:
        return []
    sizes, total = sorted(counts.values()), sum(counts.values())
    most = max(1, min(4 * max(1, sizes[len(sizes) // 2]), total // len(sizes) or 1 << 62))
    best, best_ratio = [], float("inf")
    for _ in range(6):
        bins = assign(split(counts, most), -(-len(counts) // most_taxa), most_taxa)
        ratio = max(sum(n for _, n in b) for b in bins) * len(bins) / total if total else 0.0
        if ratio < best_ratio:
            best, best_ratio = bins, ratio
        if ratio <= 1.05 or most <= 1:
            break
        most //= 2
    return best
