"""Many sequences of unequal length side by side in time-major lanes, for recurrent models in numpy.

`Lanes` holds whole sequences at once, for models that look both ways. `windows` feeds sequences of any length through a fixed number of
lanes, a window of steps at a time, for models that carry a state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Window:
    """target, inputs (the token before), starts and held (False beyond a lane's end): (steps, lanes). parts are (tag, whether the
    sequence ends here) of each piece of a sequence; first, the piece's begin in the transposed, flat window. kept: the lanes of the
    window before that go on, in order; lanes beyond them are new."""

    target: np.ndarray
    inputs: np.ndarray
    starts: np.ndarray
    held: np.ndarray
    parts: list[tuple]
    first: np.ndarray
    kept: np.ndarray

    def resumed(self, h: np.ndarray) -> np.ndarray:
        """The lanes' states, from those after the window before."""
        out = np.zeros((self.target.shape[1], h.shape[1]), h.dtype)
        out[: len(self.kept)] = h[self.kept]
        return out


def windows(sequences: Iterator[tuple], width: int, steps: int, begin: int) -> Iterator[Window]:
    """All (tag, ids) side by side; a lane whose sequence ends takes the next one at once, so memory has a bound and lanes stay full
    however lengths differ. `begin` is the input of a sequence's first step. Sequences have an element or more."""
    waiting, lanes, kept = iter(sequences), [], np.zeros(0, np.int64)
    while True:
        while len(lanes) < width and (new := next(waiting, None)) is not None:
            lanes.append((*new, 0))
        if not lanes:
            return
        n = len(lanes)
        pieces, inputs, held, starts = [], np.empty((n, steps), np.int32), np.ones((n, steps), bool), np.zeros((n, steps), bool)
        before, parts, first, begun, going, rest = [], [], [], [], [], []
        for k, lane in enumerate(lanes):
            tag, ids, pos = lane
            before.append(ids[pos - 1] if pos else begin)
            at, end = k * steps, (k + 1) * steps
            while True:
                piece = ids[pos : pos + end - at]
                pieces.append(piece)
                if not pos:
                    begun.append(at)
                first.append(at)
                pos += len(piece)
                at += len(piece)
                ends = pos == len(ids)
                parts.append((tag, ends))
                if ends:
                    new = next(waiting, None)
                    if new is None:
                        if at < end:
                            held[k, at - end :] = False
                            pieces.append(np.zeros(end - at, np.int32))
                        break
                    (tag, ids), pos = new, 0
                if at == end:
                    going.append(k)
                    rest.append((tag, ids, pos))
                    break
        target = np.concatenate(pieces, dtype=np.int32, casting="unsafe").reshape(n, steps)
        inputs[:, 0] = before
        starts.ravel()[begun] = True
        inputs[:, 1:] = target[:, :-1]
        inputs[starts] = begin
        yield Window(*(np.ascontiguousarray(a.T) for a in (target, inputs, starts, held)), parts, np.array(first), kept)
        lanes, kept = rest, np.array(going, np.int64)


class Lanes:
    """Sequences packed one after another into at most `width` lanes of similar length; no sequence is cut. There are no more lanes than
    the longest sequence fits into all of them, so the arrays stay within about twice the sequences, however long one is.

    `place` scatters values of the concatenated sequences to a (steps, width) array, `collect` is the inverse. Lanes are sorted by
    length, so the lanes that still run at step t are the first `active[t]`. `starts` marks the first element of each sequence.
    """

    def __init__(self, lengths: np.ndarray, width: int) -> None:
        lengths = np.asarray(lengths, np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        width = min(width, -(-int(lengths.sum()) // max(1, int(lengths.max(initial=0)))), len(lengths))
        heap = [(0, k) for k in range(max(1, width))]
        members: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-lengths, kind="stable").tolist():
            if lengths[i]:
                load, k = heapq.heappop(heap)
                members[k].append(i)
                heapq.heappush(heap, (load + int(lengths[i]), k))
        loads = np.array([int(lengths[m].sum()) for m in members])
        order = np.argsort(-loads, kind="stable")
        self.steps, self.width = int(loads.max(initial=0)), len(order)
        self.row, self.col = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.int32)
        self.starts = np.zeros((self.steps, self.width), bool)
        for c, k in enumerate(order.tolist()):
            at = 0
            for i in members[k]:
                n = int(lengths[i])
                self.row[offsets[i] : offsets[i + 1]] = np.arange(at, at + n)
                self.col[offsets[i] : offsets[i + 1]] = c
                self.starts[at, c] = True
                at += n
        self.active = np.searchsorted(-loads[order], -np.arange(self.steps), side="left")

    def place(self, values: np.ndarray, fill) -> np.ndarray:
        out = np.full((self.steps, self.width), fill, values.dtype)
        out[self.row, self.col] = values
        return out

    def collect(self, grid: np.ndarray) -> np.ndarray:
        return grid[self.row, self.col]
