"""SentencePiece encoding and decoding: distinct segmentations sampled by a perturbed A* search.

A text is cut into units at spaces, which no piece crosses, so the lattice of a text is a chain of the
lattices of its units; each distinct unit's lattice is built once per bank. Backward sums of the lattice
are the exact heuristic of the search: a partial path carries the log of all the probability that it
leads to. Gumbel noise on those sums, handed down from the whole to its parts, makes the k best
perturbed segmentations a sample of k without replacement. The agenda holds bundles of segmentations, each "like a
path before some unit and other than it there"; the best is popped, completed by sampling each unit from
its lattice, and leaves new bundles behind. What a bundle holds is summed over the branches that leave the
taken paths, never taken from a whole, so no segmentation is too unlikely to be found. The perturbed score
of the best bundle left after k is the threshold of the inclusion scores.

Paths of all texts of a batch are completed together in numpy; the noise of a text is a hash of its
row key, the sample's number and the place, so partitions and batches don't change a result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
#: Characters of text sampled together, and edges that a bank of lattices holds before it starts anew.
BATCH_CHARS, BANK_EDGES = 500_000, 3_000_000
#: A path of a higher log-probability than this has what it leaves of its unit summed from the other edges.
NEAR = -1e-3
_PRIME = np.uint64(0x100000001B3)
_UNITS = re.compile(r" *[^ ]+| +$")
#: Stands for a literal U+2581 inside a text, which is no space: a lone surrogate, which no text holds.
_LITERAL = "\udfff"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


UNIGRAM, BPE = 1, 2


def model_type(data: bytes) -> int:
    """What the model file says of itself: field 3 of its trainer's settings, which are field 2; unigram where unsaid."""
    settings = next((v for n, v in _fields(data) if n == 2), b"")
    return next((v for n, v in _fields(settings) if n == 3), UNIGRAM)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (normal pieces as text, byte pieces as bytes, others None) and log-probabilities of normal pieces."""

    pieces: list[str | bytes | None]
    logp: np.ndarray
    byte_ids: list[int]
    byte_logp: float

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file. Scores of a unigram model are log-probabilities; scores of a BPE model are the
        order of merges, which Zipf's law turns into them: log-probability is minus the log of the rank.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces: list[str | bytes | None] = [None] * n
        scores = np.full(n, -np.inf)
        byte_ids = [-1] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:-1], 16)] = i
                pieces[i] = bytes([int(p[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[i], scores[i] = p, sp.get_score(i)
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces")
        if any(isinstance(p, str) and SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a space")
        normal = np.flatnonzero(np.isfinite(scores))
        logp = np.full(n, -np.inf)
        ordered = normal[np.argsort(-scores[normal], kind="stable")]
        if model_type(sp.serialized_model_proto()) == UNIGRAM:
            logp[normal] = scores[normal]
        else:
            logp[ordered] = -np.log(np.arange(len(ordered)) + 2.0)
        logp[normal] -= np.log(np.exp(logp[normal]).sum())
        return cls(pieces, logp, byte_ids, float(logp[normal].min()) - 10.0)

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        return b"".join(self.table.take(np.asarray(ids, np.int64)).tolist())[1:].decode("utf-8", "surrogatepass") if len(ids) else ""

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """decode() of many segmentations at once, as bytes: ids of all in order, and the place where each ends, from 0."""
        taken = self.column.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data, cuts = memoryview(taken.buffers()[2] or b""), offsets[ends].tolist()
        return [bytes(data[a + 1 : b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @property
    def table(self) -> np.ndarray:
        """The bytes of each piece."""
        if "_table" not in self.__dict__:
            made = np.empty(len(self.pieces), object)
            made[:] = [p if isinstance(p, bytes) else (p or "").replace(SPACE, " ").encode() for p in self.pieces]
            object.__setattr__(self, "_table", made)
        return self.__dict__["_table"]

    @property
    def column(self) -> pa.Array:
        """table for Arrow."""
        if "_column" not in self.__dict__:
            object.__setattr__(self, "_column", pa.array(self.table.tolist(), pa.large_binary()))
        return self.__dict__["_column"]


class Matcher:
    """Pieces and their prefixes in an open hash table over hashes of their characters."""

    BITS = 18

    def __init__(self, vocabulary: Vocabulary) -> None:
        found: dict[str, int] = {}
        for i, p in enumerate(vocabulary.pieces):
            if isinstance(p, str) and p:
                found.setdefault(p, i)
        entries: dict[int, int] = {}
        for s in {*found, *(p[:d] for p in found for d in range(1, len(p)))}:
            h = 0
            for c in s:
                h = ((h ^ ord(c)) * int(_PRIME) + 1) % 2**64
            if h in entries or h == 0:
                raise ValueError("two pieces share a hash")
            entries[h] = found.get(s, -1)
        bits = max(self.BITS, (4 * len(entries)).bit_length())
        self.longest, self.shift, self.mask = max(map(len, found)), np.uint64(64 - bits), 2**bits - 1
        self.keys, self.ids = np.zeros(2**bits, np.uint64), np.full(2**bits, -1, np.int32)
        for h, i in entries.items():
            slot = (h * 0x9E3779B97F4A7C15 % 2**64) >> int(self.shift)
            while self.keys[slot]:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ids[slot] = h, i

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for those that aren't there."""
        slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != h) & (got != 0))
        slot[got == 0] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            slot[open_[got == 0]] = -1
            open_ = open_[(got != h[open_]) & (got != 0)]
        return slot

    def matches(self, code: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, piece ids) of all pieces in code; room: characters up to the end of a place's unit."""
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        for d in range(1, self.longest + 1):
            fits = room[at] >= d
            at, h = at[fits], h[fits]
            if not len(at):
                return
            h = (h ^ code[at + d - 1]) * _PRIME + np.uint64(1)
            slot = self._slots(h)
            known = np.flatnonzero(slot >= 0)
            at, h, got = at[known], h[known], self.ids[slot[known]]
            whole = np.flatnonzero(got >= 0)
            yield d, at[whole], got[whole]


class Rows:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            new = np.empty(max(2 * len(self.data), self.n + len(more)), self.data.dtype)
            new[: self.n] = self.data[: self.n]
            self.data = new
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def clear(self) -> None:
        """Empties it, but keeps its memory for what comes, unless that is far more than a bank takes."""
        self.n = 0
        if len(self.data) > 4 * BANK_EDGES:
            self.data = np.empty(1024, self.data.dtype)


class Bank:
    """Lattices of distinct units, as edges sorted by node. A path's edge names its piece, or a character by its bytes."""

    def __init__(self, vocabulary: Vocabulary, theta: float = 1.0, matcher: Matcher | None = None) -> None:
        self.vocabulary, self.theta, self.matcher = vocabulary, theta, matcher or Matcher(vocabulary)
        self.types: dict[str, int] = {}  # the first node of each unit
        self._count = Rows(np.int32)
        self._first, self._cum, self._logc, self._others, self._target, self._piece = Rows(np.int32), Rows(np.float64), Rows(np.float64), Rows(np.float64), Rows(np.int32), Rows(np.int32)

    def clear(self) -> None:
        self.types = {}
        for rows in (self._count, self._first, self._cum, self._logc, self._others, self._target, self._piece):
            rows.clear()

    @property
    def first(self) -> np.ndarray:
        """First edge of each node; -1 at a unit's end."""
        return self._first.data

    @property
    def count(self) -> np.ndarray:
        """How many edges each node has."""
        return self._count.data

    @property
    def cum(self) -> np.ndarray:
        """Cumulated conditional probability of each edge; 2 for a node's last."""
        return self._cum.data

    @property
    def logc(self) -> np.ndarray:
        return self._logc.data

    @property
    def others(self) -> np.ndarray:
        """Log of the conditional probability that a node's likeliest edge leaves to the others; known of edges above NEAR alone."""
        return self._others.data

    @property
    def target(self) -> np.ndarray:
        return self._target.data

    @property
    def piece(self) -> np.ndarray:
        """Id of each edge's piece, or -1 - code point."""
        return self._piece.data

    def nodes(self, units: list[str]) -> np.ndarray:
        """The root node of each unit; new units get lattices."""
        out = np.fromiter(map(self.types.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(out < 0)
        if len(new) and len(self._cum) > BANK_EDGES:
            self.clear()
            new = np.arange(len(units))
        if len(new):
            missing = [units[i] for i in new.tolist()]
            once = list(dict.fromkeys(missing))
            roots = self._add(once)
            out[new] = roots if len(once) == len(missing) else [self.types[u] for u in missing]
        return out

    def _add(self, new: list[str]) -> np.ndarray:
        """Makes the lattices of distinct new units; the root node of each."""
        n0, e0 = len(self._first), len(self._cum)
        # a unit's own text stands for one space before it
        joined = SPACE + SPACE.join(new).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, new), np.int64, len(new)) + 1
        begin = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(new)), size)
        room = (begin + size)[unit] - np.arange(len(code))
        node = np.arange(len(code)) + unit  # each unit has one node more than characters
        roots = begin + np.arange(len(new)) + n0
        self.types.update(zip(new, roots.tolist(), strict=True))
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # nodes, length, pieces, log-probabilities
        single = np.zeros(len(code), bool)
        for d, at, ids in self.matcher.matches(code, room):
            if d == 1:
                single[at] = True
            found.append((node[at], d, ids, self.vocabulary.logp[ids]))
        odd = np.flatnonzero(~single)
        c = code[odd].astype(np.int64)
        found.append((node[odd], 1, (-1 - c).astype(np.int32), _n_bytes(c) * self.vocabulary.byte_logp))
        # edges by their node's distance from the unit's end; a node's longest pieces come first
        n = len(code) + len(new)
        far = np.repeat(np.cumsum(size + 1) - 1, size + 1) - np.arange(n)
        order = np.argsort(far.astype(np.uint16) if far.max() < 65536 else far, kind="stable")
        out = np.zeros(n, np.int64)
        for at, _, _, _ in found:
            out[at] += 1
        free = np.empty(n, np.int64)
        free[order] = np.cumsum(out[order]) - out[order]  # where a node's next edge goes
        m = int(out.sum())
        src, dst, piece, logp = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int32), np.empty(m)
        for at, d, ids, lp in sorted(found, key=lambda f: -f[1]):
            to = free[at]
            free[at] = to + 1
            src[to], dst[to], piece[to], logp[to] = at, at + d, ids, lp
        logp *= self.theta
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if m else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, m))
        # backward sums
        beta = np.zeros(n)
        level = far[src]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(src)]]) if len(src) else np.zeros(1, np.int64)
        wide = np.flatnonzero(np.diff(cuts) > 48)
        split = int(wide[-1]) + 1 if len(wide) else 0  # from there on few units are as long
        inner = np.searchsorted(heads, cuts[: split + 1]).tolist()
        cuts_ = cuts[: split + 1].tolist()
        for a, b, i, j in zip(cuts_[:-1], cuts_[1:], inner[:-1], inner[1:], strict=True):
            value = logp[a:b] + beta[dst[a:b]]
            here = heads[i:j] - a
            top = np.maximum.reduceat(value, here)
            beta[src[heads[i:j]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, times[i:j])), here))
        at = int(cuts[split])
        if at < len(src):
            _backward(beta, src[at:], dst[at:], logp[at:])
        logc = np.minimum(logp + beta[dst] - beta[src], 0.0)
        first, count = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        first[src[heads]] = heads + e0
        count[src[heads]] = times
        # what an edge that takes nearly all leaves, as the sum of the others
        share = np.exp(logc)
        sums = np.cumsum(share)
        others = np.full(len(src), -np.inf)
        best = np.flatnonzero((logc > 2 * NEAR) & np.repeat(times > 1, times))
        if len(best):
            head, c = first[src[best]] - e0, count[src[best]].astype(np.int64)
            here = np.cumsum(c) - c
            beside = share[np.repeat(head - here, c) + np.arange(int(c.sum()))]
            beside[best - head + here] = 0.0
            with np.errstate(divide="ignore"):
                left = np.log(np.add.reduceat(beside, here))
            for i in np.flatnonzero(np.isinf(left)).tolist():  # too little to be summed but as logs
                left[i] = np.logaddexp.reduce(np.delete(logc[head[i] : head[i] + c[i]], best[i] - head[i]))
            others[best] = left
        cum = sums - np.repeat(np.concatenate([[0.0], sums])[heads], times)
        cum[np.append(heads[1:], len(src)) - 1] = 2.0
        for rows, more in ((self._first, first), (self._count, count), (self._cum, cum), (self._logc, logc), (self._others, others), (self._target, dst + n0), (self._piece, piece)):
            rows.add(more)
        return roots

    def walk(self, root: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path sampled for each unit: (pieces of each, log-probability of each, edges of all in order)."""
        first, cum, target = self.first, self.cum, self.target
        logc = self.logc
        at, now, next_, left, own = np.arange(len(root)), root, first[root], seed, np.zeros(len(root))
        steps, n, logp = [], np.zeros(len(root), np.int64), np.zeros(len(root))
        t = 0
        while len(at) > 4:
            u = uniform(left, t)
            edge = next_
            over = np.flatnonzero(u >= cum[edge])
            while len(over):
                edge[over] += 1
                over = over[u[over] >= cum[edge[over]]]
            own = own + logc[edge]
            steps.append((at, edge))
            t += 1
            now = target[edge]
            next_ = first[now]
            ended = np.flatnonzero(next_ < 0)
            n[at[ended]], logp[at[ended]] = t, own[ended]
            open_ = np.flatnonzero(next_ >= 0)
            at, now, next_, left, own = at[open_], now[open_], next_[open_], left[open_], own[open_]
        ends = [(i, t, self._finish(int(x), int(seed[i]), t)) for i, x in zip(at.tolist(), now.tolist(), strict=True)]
        for (i, _, path), x in zip(ends, own.tolist(), strict=True):
            n[i] = t + len(path)
            logp[i] = np.cumsum(np.append(x, logc[path]))[-1]  # one after the other, so that no batch changes a sum
        start = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.int32)
        for t, (at, edge) in enumerate(steps):
            flat[start[at] + t] = edge
        for i, t, path in ends:
            flat[start[i] + t : start[i] + t + len(path)] = path
        return n, logp, flat

    def _finish(self, node: int, seed: int, t: int) -> np.ndarray:
        """The edges of a walk from node to its unit's end, one after the other."""
        first, cum, target, path = self.first, self.cum, self.target, []
        while (edge := int(first[node])) >= 0:
            u = _uniform(seed, t)
            while u >= cum[edge]:
                edge += 1
            path.append(edge)
            node, t = target[edge], t + 1
        return np.array(path, np.int32)

    def rest(self, logp: np.ndarray, start: np.ndarray, count: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The log of what each path leaves of its unit: at each step the other edges, after the steps before."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log(-np.expm1(logp))
        near = np.flatnonzero(logp > NEAR)  # what a whole leaves is rounded away there; its edges are all the likeliest
        if len(near):
            c = count[near]
            here = np.cumsum(c) - c
            edge = flat[np.repeat(start[near] - here, c) + np.arange(int(c.sum()))]
            step = self.logc[edge]
            before = np.cumsum(step) - step
            before -= np.repeat(before[here], c)
            out[near] = np.logaddexp.reduceat(before + self.others[edge], here)
        return out


def _backward(beta: np.ndarray, src: np.ndarray, dst: np.ndarray, logp: np.ndarray) -> None:
    """Fills beta of src, edge after edge; the edges of a node lie together, after those of the nodes that it leads to."""
    known = dict(zip((x := np.unique(dst)).tolist(), beta[x].tolist(), strict=True))
    exp, log = math.exp, math.log
    values: list[float] = []
    now = -1

    def close() -> None:
        if len(values) == 1:
            known[now] = values[0]
        else:
            top = max(values)
            known[now] = top + log(sum([exp(v - top) for v in values]))

    for s, d, p in zip(src.tolist(), dst.tolist(), logp.tolist(), strict=True):
        if s != now:
            if now >= 0:
                close()
            now, values = s, []
        values.append(p + known[d])
    close()
    at = np.unique(src)
    beta[at] = [known[i] for i in at.tolist()]


class Taken:
    """Paths of a unit that are taken, as a trie; at each of its nodes the log of what is left free below it."""

    def __init__(self, bank: Bank, root: int, path) -> None:
        self.bank = bank
        self.first, self.below, self.free, self.weights = [], [], [], []
        self._node(root)
        self.add(path)

    def _node(self, node: int) -> int:
        """A new node of the trie: its first edge, and the log of what is free behind each of its edges."""
        first = int(self.bank.first[node])
        self.first.append(first)
        self.weights.append(self.bank.logc[first : first + int(self.bank.count[node])].tolist() if first >= 0 else [])
        self.below.append({})
        self.free.append(0.0)
        return len(self.first) - 1

    def add(self, path) -> None:
        path = np.asarray(path).tolist()
        walked, i, own = [0], 0, self.bank.logc[path].tolist()
        for e in path:
            if e not in self.below[i]:
                self.below[i][e] = self._node(int(self.bank.target[e]))
            i = self.below[i][e]
            walked.append(i)
        self.free[i] = -math.inf
        for at in range(len(path) - 1, -1, -1):
            i, e = walked[at], path[at]
            weights = self.weights[i]
            weights[e - self.first[i]] = own[at] + self.free[walked[at + 1]]
            top = max(weights)
            self.free[i] = top + math.log(sum([math.exp(w - top) for w in weights])) if top > -math.inf else -math.inf

    def sample(self, seed: int) -> tuple[list[int], float] | None:
        """A path sampled among those that are free, with its log-probability; None if there is none."""
        bank = self.bank
        if self.free[0] == -math.inf:
            return None
        path, i, t = [], 0, 0
        while True:  # as long as the path follows taken ones
            first, weights = self.first[i], self.weights[i]
            top = max(weights)
            share = [math.exp(w - top) for w in weights]
            u = _uniform(seed, t) * sum(share)
            k = 0
            while k < len(share) - 1 and u >= share[k]:
                u -= share[k]
                k += 1
            while share[k] == 0.0:  # rounding at the upper end
                k -= 1
            e = first + k
            path.append(e)
            t += 1
            if e not in self.below[i]:
                break
            i = self.below[i][e]
        path += bank._finish(int(bank.target[path[-1]]), seed, t).tolist()
        return path, float(bank.logc[path].sum())


def uniform(seed: np.ndarray, t: int) -> np.ndarray:
    """Numbers in [0, 1), a hash of seed and t."""
    x = seed + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _uniform(seed: int, t: int) -> float:
    """uniform() of one seed."""
    x = (seed + (t + 1) * 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53


def _seeds(seed: np.ndarray, sample: int, place: np.ndarray) -> np.ndarray:
    x = seed ^ np.uint64((sample + 1) * 0xD6E8FEB86659FD93 % 2**64)
    x = (x + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


def _seed(seed: int, sample: int, place: int) -> int:
    """_seeds() of one text and place."""
    x = seed ^ (sample + 1) * 0xD6E8FEB86659FD93 % 2**64
    x = (x + place * 0xA0761D6478BD642F) * 0xE7037ED1A0B428DB % 2**64
    return x ^ x >> 32


@dataclass(order=True)
class Bundle:
    """Segmentations that follow a sample before a unit and are none of taken there; least first, so negated."""

    minus: float
    sample: int = field(compare=False)
    unit: int = field(compare=False)
    taken: np.ndarray | Taken = field(compare=False)


@dataclass
class Samples:
    """Of a batch: for each text and sample its log-probability, perturbed score, inclusion score and edges."""

    logp: list[list[float]]
    perturbed: list[list[float]]
    inclusion: list[list[float]]
    edges: list[list[np.ndarray]]


def units_of(text: str) -> list[str]:
    """Cut at spaces; a unit's first space is left out, as all have one."""
    if SPACE in text:
        text = text.replace(SPACE, _LITERAL)
    if not text:
        return []
    if "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNITS.findall(" " + text)]


def roots_of(texts: list[str], bank: Bank) -> tuple[np.ndarray, np.ndarray]:
    """How many units each text has, and the root nodes of all units in order.

    Texts whose spaces stand alone between words are cut and told apart by Arrow; only distinct units become
    strings here. The others go by units_of().
    """
    column = pa.array(texts, pa.string())
    plain = pc.invert(pc.or_(pc.match_substring_regex(column, "^ |  | $|^$"), pc.match_substring(column, SPACE)))
    parts = pc.split_pattern(column.filter(plain), " ")
    coded = parts.flatten().dictionary_encode()
    is_plain = plain.to_numpy(zero_copy_only=False)
    odd = [units_of(texts[i]) for i in np.flatnonzero(~is_plain).tolist()]
    sizes = np.empty(len(texts), np.int64)
    sizes[is_plain] = np.diff(parts.offsets.to_numpy())
    sizes[~is_plain] = [len(u) for u in odd]
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    nodes = bank.nodes([*distinct, *(u for units in odd for u in units)])
    from_plain = np.repeat(is_plain, sizes)
    root = np.empty(len(from_plain), np.int64)
    root[from_plain] = nodes[: len(distinct)][coded.indices.to_numpy()]
    root[~from_plain] = nodes[len(distinct) :]
    return sizes, root


def sample(texts: list[str], seeds: np.ndarray, bank: Bank, k: int) -> Samples:
    """Up to k distinct segmentations of each text, best perturbed score first."""
    sizes, root = roots_of(texts, bank)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(root)) - begin[doc]
    full = np.flatnonzero(sizes)
    score = -np.log(-np.log(uniform(seeds, 0) + 2.0**-54))  # the best perturbed score of all segmentations
    out = Samples([[] for _ in texts], [[] for _ in texts], [[] for _ in texts], [[] for _ in texts])
    agenda: list[list[Bundle]] = [[] for _ in texts]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each sample: starts and counts of units' edges, and the edges
    logps: list[np.ndarray] = []
    # of texts that take part: where the new path leaves its base
    active = full
    base = np.zeros(len(texts), np.int64)
    leave = np.full(len(texts), -1, np.int64)
    forced: dict[int, tuple[list[int], float, Bundle]] = {}
    for s in range(k):
        if not len(active):
            break
        part = np.zeros(len(texts), bool)
        part[active] = True
        mine = part[doc]
        fresh = np.flatnonzero(mine & (place > leave[doc]))
        owner = doc[fresh]
        unit_seeds = _seeds(seeds[owner], s, place[fresh])
        n, lp, flat = bank.walk(root[fresh], unit_seeds)
        count, logp = np.zeros(len(root), np.int64), np.zeros(len(root))
        count[fresh], logp[fresh] = n, lp
        start = np.zeros(len(root), np.int64)
        start[fresh] = np.cumsum(n) - n
        source = [flat]
        if s:
            offset = len(flat)
            for b in range(s):  # units before the leave come from the base
                old = np.flatnonzero(mine & (place < leave[doc]) & (base[doc] == b))
                if not len(old):
                    continue
                o_start, o_count, o_flat = kept[b]
                c = o_count[old]
                here = np.cumsum(c) - c
                source.append(o_flat[np.repeat(o_start[old] - here, c) + np.arange(int(c.sum()))])
                start[old], count[old], logp[old] = offset + here, c, logps[b][old]
                offset += int(c.sum())
            for d in active.tolist():
                path, path_logp, _ = forced[d]
                u = begin[d] + leave[d]
                start[u], count[u], logp[u] = offset, len(path), path_logp
                source.append(np.array(path, np.int32))
                offset += len(path)
        flat = np.concatenate(source)
        if s:  # in the order of units
            here = np.cumsum(count) - count
            start, flat = here, flat[np.repeat(start - here, count) + np.arange(int(count.sum()))]
        kept.append((start, count, flat))
        logps.append(logp)
        # bundles that the new paths leave behind at their fresh units
        before = np.cumsum(logp) - logp
        before -= before[np.minimum(begin, max(0, len(before) - 1))][doc] if len(before) else 0
        with np.errstate(divide="ignore"):
            mass = before[fresh] + bank.rest(logp[fresh], start[fresh], count[fresh], flat)
        limit = score[owner]
        noise = -np.log(uniform(unit_seeds, -2) + 2.0**-54)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            best = np.where(np.isfinite(mass), mass - np.log(np.exp(np.minimum(mass - limit, 700.0)) + noise), -np.inf)
        total = np.bincount(doc[mine], logp[mine], minlength=len(texts))
        for d in active.tolist():
            out.logp[d].append(float(total[d]))
            out.perturbed[d].append(float(score[d]))
        if len(fresh):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            times = np.diff(np.append(heads, len(fresh)))
            for _ in range(k - s):  # no more of them can be among the best k + 1
                top = np.maximum.reduceat(best, heads)
                hit = np.flatnonzero((best == np.repeat(top, times)) & np.isfinite(best))
                if not len(hit):
                    break
                hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
                for i in hit.tolist():
                    u = int(fresh[i])
                    path = flat[start[u] : start[u] + count[u]]
                    heapq.heappush(agenda[doc[u]], Bundle(-float(best[i]), s, int(place[u]), path))
                best[hit] = -np.inf
        if s:
            for d in active.tolist():  # what is left of the bundle that was popped
                path, _, old = forced[d]
                old.taken.add(path)
                if old.taken.free[0] > -np.inf:
                    m = float(before[begin[d] + leave[d]]) + old.taken.free[0]
                    noise = -math.log(_uniform(_seed(int(seeds[d]), s, int(sizes[d]) + 1), 0) + 2.0**-54)
                    heapq.heappush(agenda[d], Bundle(-(m - math.log(math.exp(min(m - score[d], 700.0)) + noise)), old.sample, old.unit, old.taken))
        # the next samples
        forced = {}
        if s + 1 < k:
            for d in active.tolist():
                while agenda[d]:
                    got = heapq.heappop(agenda[d])
                    if not isinstance(got.taken, Taken):
                        got.taken = Taken(bank, int(root[begin[d] + got.unit]), got.taken)
                    found = got.taken.sample(_seed(int(seeds[d]), s + 1, got.unit))
                    if found:
                        forced[d] = (*found, got)
                        base[d], leave[d], score[d] = got.sample, got.unit, -got.minus
                        break
            active = np.array(sorted(forced), np.int64)
    for d in range(len(texts)):
        if not sizes[d]:
            out.logp[d], out.perturbed[d], out.inclusion[d], out.edges[d] = [0.0], [float(score[d])], [1.0], [np.empty(0, np.int32)]
            continue
        left = -agenda[d][0].minus if agenda[d] else -np.inf
        out.inclusion[d] = [float(-np.expm1(-np.exp(min(lp - left, 700.0)))) if np.isfinite(left) else 1.0 for lp in out.logp[d]]
        a, b = int(begin[d]), int(begin[d] + sizes[d])
        for s in range(len(out.logp[d])):
            start, count, flat = kept[s]
            out.edges[d].append(flat[int(start[a]) : int(start[b - 1] + count[b - 1])])
    return out


def _n_bytes(code: np.ndarray) -> np.ndarray:
    """How many bytes of UTF-8 each code point has; the literal's stand-in has as many as the literal."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def ids_of(edges: np.ndarray, bank: Bank) -> np.ndarray:
    """Piece ids of a path; a character without a piece is its bytes."""
    return ids_of_all([edges], bank)[0]


def ids_of_all(paths: list[np.ndarray], bank: Bank) -> tuple[np.ndarray, np.ndarray]:
    """ids_of() of many paths, one after the other, and the place where each ends, from 0."""
    ends = np.cumsum([0, *map(len, paths)])
    ids = bank.piece[np.concatenate([*paths, np.empty(0, np.int32)])]
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, ends
    code, by_byte = -1 - ids[odd], np.array(bank.vocabulary.byte_ids, np.int32)
    code[code == ord(_LITERAL)] = ord(SPACE)
    width = _n_bytes(code)
    size = np.ones(len(ids), np.int64)
    size[odd] = width
    last = np.cumsum(size)
    out = np.empty(int(last[-1]), np.int32)
    out[last - size] = ids
    for w, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        these = np.flatnonzero(width == w)
        c, at = code[these], last[odd[these]]
        for back in range(1, w):
            out[at - back] = by_byte[0x80 | (c >> 6 * (back - 1)) & 0x3F]
        out[at - w] = by_byte[lead | c >> 6 * (w - 1)]
    return out, np.concatenate([[0], last])[ends]


def row_seed(key, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(key).encode("utf-8", "surrogatepass"), seed % 2**64)


#: A worker's matcher, by model; banks end with their task.
_MATCHERS: dict[str, Matcher] = {}


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = 2, theta: float = 1.0, seed: int = 0, ids: bool = True, decoded: bool = False, verify: bool = True) -> DataFrame:
    """Up to k rows for each row of docs, best perturbed score first: key, sample (from 1), n_pieces,
    log_prob, perturbed, inclusion, ids_sha256 (of little-endian 32-bit ids) and round_trip (null unless
    verify: whether the ids decode to the text); ids: with the piece ids; decoded: with the decoded text.

    model: the path of a SentencePiece model file, read by the driver alone. A text with fewer distinct
    segmentations gives fewer rows; however unlikely one is, it counts. A null text is an empty one, whose one segmentation has no piece. Rows that repeat
    a key get the same noise, so repeated rows give repeated results. Other columns are not looked at; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        if model not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[model] = Matcher(vocabulary)
        bank = Bank(vocabulary, theta, _MATCHERS[model])

        def rows(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            seeds = np.array([row_seed(x, seed) for x in keys.to_pylist()], np.uint64)
            got = sample(texts, seeds, bank, k)
            at = [d for d, x in enumerate(got.logp) for _ in x]
            flat, ends = ids_of_all([e for x in got.edges for e in x], bank)
            little, cuts = flat.astype("<i4"), ends.tolist()
            back = vocabulary.decode_all(flat, ends) if verify or decoded else []
            whole = [t.encode() for t in texts] if verify else []
            cols = [
                keys.take(pa.array(at, pa.int64())),
                pa.array([s + 1 for x in got.logp for s in range(len(x))], pa.int32()),
                pa.array(np.diff(ends), pa.int64()),
                *(pa.array([v for x in y for v in x], pa.float64()) for y in (got.logp, got.perturbed, got.inclusion)),
                pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                pa.array([b == whole[d] for d, b in zip(at, back, strict=True)] if verify else [None] * len(at), pa.bool_()),
            ]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
            if decoded:
                cols.append(pa.array([b.decode("utf-8", "surrogatepass") for b in back], pa.string()))
            return pa.RecordBatch.from_arrays(cols, names=names)

        gc.disable()  # what is made here has no cycles, and there is much of it
        try:
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                lo, size = 0, 0
                for i, n in enumerate(pc.binary_length(texts).to_pylist()):
                    size += n or 0
                    if size >= BATCH_CHARS or i + 1 == len(texts):
                        n_rows = i + 1 - lo
                        yield rows(keys.slice(lo, n_rows), [t or "" for t in texts.slice(lo, n_rows).to_pylist()])
                        lo, size = i + 1, 0
        finally:
            gc.enable()

    names = [key, "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "round_trip"]
    schema = f"`{key}` {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean"
    if ids:
        names.append("ids")
        schema += ", ids array<int>"
    if decoded:
        names.append("decoded")
        schema += ", decoded string"
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows with piece ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else shared.value.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(f"`{key}`", f"`{ids}`").mapInArrow(run, f"`{key}` {kind}, text string")
