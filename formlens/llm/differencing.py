"""Karmarkar-Karp multiway differencing of a bounded group of lengths into windows."""

from __future__ import annotations

import heapq

import numpy as np


def balanced_windows(lengths: np.ndarray, n_windows: int) -> np.ndarray:
    """The window of every item; the windows' sums are nearly equal.

    The items, by falling length, make partial partitions of one item per window. The two partial
    partitions with the widest spread between their windows are merged, the fullest windows of one
    with the emptiest of the other, until one partition is left (ties: the earlier made first).
    """
    n = len(lengths)
    ranked = np.argsort(-lengths, kind="stable")
    padded = np.concatenate((ranked, np.full(-n % n_windows, -1))).reshape(-1, n_windows)
    sums = np.where(padded < 0, 0, lengths[padded]) if n else np.zeros(padded.shape, dtype=np.int64)
    # A partition: its spread, its number, the sums by falling size, and the rows of items below each sum.
    heap = [(int(row[-1] - row[0]), i, row, padded[i : i + 1]) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, fuller, items = heapq.heappop(heap)
        _, _, other, other_items = heapq.heappop(heap)
        joined = fuller + other[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        items = np.concatenate((items, other_items[:, ::-1]))[:, order]
        heapq.heappush(heap, (int(joined[-1] - joined[0]), made, joined, items))
        made += 1
    window = np.zeros(n, dtype=np.int64)
    if heap:
        placed = heap[0][3]
        slots = np.broadcast_to(np.arange(n_windows), placed.shape)
        window[placed[placed >= 0]] = slots[placed >= 0]
    return window


def fitting_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity`` for items of at most that: their number rises until all fit."""
    n_windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = balanced_windows(lengths, n_windows)
        sums = np.bincount(window, weights=lengths, minlength=n_windows)
        if sums.max(initial=0) <= capacity:
            return window, n_windows
        n_windows += 1
