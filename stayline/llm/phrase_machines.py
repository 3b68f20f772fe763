"""Weighted acyclic automata over words, as arrays: built from sorted phrases, expanded, added up and walked.

A phrase is a row of labels, padded with zeros; a machine accepts counted phrases of up to a few words. An arc carries a
word's label and the count of the phrase that ends there (0 if it isn't counted). Phrases are added in sorted order: the
labels a phrase shares with the one before are its path so far, and the states left behind are complete. Complete states
with equal arcs are one state, however often they are reached, so tails that many phrases share are kept once.

States lie in layers by the number of words read. State 0 of each layer has no arcs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .shared import mixed


@dataclass
class Layer:
    """Arcs from one layer to the next, by state and label: of state s > 0 those from ``ends[s - 1]`` to ``ends[s]``."""

    ends: np.ndarray
    label: np.ndarray  # place in the machine's labels
    count: np.ndarray
    target: np.ndarray


@dataclass
class Machine:
    labels: np.ndarray  # sorted
    start: int
    layers: list[Layer]

    def packed(self) -> bytes:
        arrays = [self.labels]
        for layer in self.layers:
            arrays += [layer.ends, layer.label, layer.count, layer.target]
        parts = [struct.pack("<II", self.start, len(arrays))]
        for array in arrays:
            small = array.astype(np.min_scalar_type(int(array.max()))) if len(array) else array.astype(np.uint8)
            parts += [struct.pack("<cI", small.dtype.char.encode(), small.nbytes), small.tobytes()]
        return b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Machine:
        start, count = struct.unpack_from("<II", data)
        at, arrays = 8, []
        for _ in range(count):
            kind, size = struct.unpack_from("<cI", data, at)
            arrays.append(np.frombuffer(data[at + 5 : at + 5 + size], np.dtype(kind.decode())))
            at += 5 + size
        wide = [array.astype(np.int64) for array in arrays[1:]]
        return cls(arrays[0].astype(np.uint64), start, [Layer(*wide[i : i + 4]) for i in range(0, len(wide), 4)])

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All counted phrases and their counts."""
        found, counts = [], []
        path, state = np.zeros((1, len(self.layers)), dtype=np.uint64), np.array([self.start])
        for depth, layer in enumerate(self.layers):
            sizes = np.where(state > 0, layer.ends[state] - layer.ends[state - 1], 0)
            arc = np.repeat(layer.ends[state - 1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            path = np.repeat(path, sizes, axis=0)
            path[:, depth] = self.labels[layer.label[arc]]
            state = layer.target[arc]
            counted = layer.count[arc] > 0
            found.append(path[counted])
            counts.append(layer.count[arc][counted])
            path, state = path[state > 0], state[state > 0]
        return np.concatenate(found), np.concatenate(counts)

    def counts(self, phrases: np.ndarray) -> np.ndarray:
        """Of each phrase the count at the end of its path; 0 if there is no such path."""
        state = np.full(len(phrases), self.start)
        found = np.zeros(len(phrases), dtype=np.int64)
        going = np.ones(len(phrases), dtype=bool)
        for depth, layer in enumerate(self.layers):
            wanted = phrases[:, depth]
            going = going & (wanted > 0)
            rank = np.searchsorted(self.labels, wanted)
            known = going & (state > 0) & (rank < len(self.labels))
            known[known] = self.labels[rank[known]] == wanted[known]
            own = np.repeat(np.arange(len(layer.ends)), np.diff(layer.ends, prepend=0)) << 32 | layer.label
            key = state << 32 | rank
            arc = np.searchsorted(own, key)
            known &= arc < len(own)
            known[known] = own[arc[known]] == key[known]
            # A phrase that ends further on, or leaves the machine, has no count yet.
            found[going] = 0
            found[known] = layer.count[arc[known]]
            going = known
            state = np.where(known, layer.target[np.minimum(arc, max(0, len(own) - 1))] if len(own) else 0, 0)
        return found


def _lengths(phrases: np.ndarray) -> np.ndarray:
    return (phrases > 0).sum(axis=1)


def built(phrases: np.ndarray, counts: np.ndarray) -> Machine:
    """The machine of distinct phrases in sorted order (a phrase before those that go on from it)."""
    depth = phrases.shape[1]
    sizes = _lengths(phrases)
    labels, rank = np.unique(phrases[phrases > 0], return_inverse=True)
    place = np.zeros(phrases.shape, dtype=np.int64)
    place[phrases > 0] = rank
    differs = np.ones(phrases.shape, dtype=bool)
    differs[1:] = np.logical_or.accumulate(phrases[1:] != phrases[:-1], axis=1)
    # Of each depth: the rows where an arc begins, and each row's arc.
    opens = [np.flatnonzero(differs[:, d] & (sizes > d)) for d in range(depth)]
    layers: list[Layer] = []
    target = np.zeros(len(opens[-1]), dtype=np.int64)
    for d in reversed(range(depth)):
        rows = opens[d]
        count = np.where(sizes[rows] == d + 1, counts[rows], 0)
        if d:
            parent = np.searchsorted(opens[d - 1], rows, side="right") - 1
            layer, state = _shared(parent, len(opens[d - 1]), place[rows, d], count, target)
        else:
            layer = Layer(np.array([0, len(rows)]), place[rows, 0], count, target)
            state = np.array([1])
        layers.append(layer)
        target = state
    return Machine(labels, 1, layers[::-1])


def _shared(parent: np.ndarray, parents: int, label: np.ndarray, count: np.ndarray, target: np.ndarray) -> tuple[Layer, np.ndarray]:
    """States of equal arcs as one: the layer, and each parent's state."""
    state = np.zeros(parents, dtype=np.int64)
    if not len(parent):
        return Layer(np.array([0]), label, count, target), state
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    sizes = np.diff(np.append(first, len(parent)))
    arcs = mixed(mixed(mixed(label.astype(np.uint64)) + count.astype(np.uint64)) + target.astype(np.uint64))
    _, chosen, same = np.unique(
        mixed(np.add.reduceat(arcs, first) + sizes.astype(np.uint64)), return_index=True, return_inverse=True
    )
    # States that only look alike stay apart.
    like = chosen[same]
    alike = sizes[like] == sizes
    within = np.arange(len(parent)) - np.repeat(first, sizes)
    other = np.minimum(np.repeat(first[like], sizes) + within, len(parent) - 1)
    equal = (label == label[other]) & (count == count[other]) & (target == target[other])
    alike &= np.logical_and.reduceat(equal, first)
    like = np.where(alike, like, np.arange(len(first)))
    kept, number = np.unique(like, return_inverse=True)
    arc = np.repeat(first[kept] - (np.cumsum(sizes[kept]) - sizes[kept]), sizes[kept]) + np.arange(sizes[kept].sum())
    state[parent[first]] = number + 1
    ends = np.concatenate([[0], np.cumsum(sizes[kept])])
    return Layer(ends, label[arc], count[arc], target[arc]), state


def added(machines: list[Machine], least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The union of machines with counts summed: its sorted phrases of at least that count, their counts, and the sum of
    all counts."""
    phrases, counts = (np.concatenate(x) for x in zip(*[machine.phrases() for machine in machines]))
    order = np.lexsort(phrases.T[::-1])
    phrases, counts = phrases[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (phrases[1:] != phrases[:-1]).any(axis=1)]))
    counts, total = np.add.reduceat(counts, first), int(counts.sum())
    often = counts >= least
    return phrases[first][often], counts[often], total
