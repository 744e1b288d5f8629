"""Evaluation texts leaking into training texts (problem 8).

Texts become sequences of words, letter case and punctuation aside. Windows of words of every
document and every item go through the CGK random walk, a shared random map under which windows at
a small edit distance come out at a small Hamming distance; sampled positions of the walk form keys
(bit-sampling LSH), and repetitions are added until windows within the edit bound collide with the
target recall (measured on the items themselves; equal windows always collide). Colliding windows are
candidates, which an exact comparison of the two texts then settles.

Items are a held-out set of bounded size (checked); they travel to the documents, which are read
once and never shuffled.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import map_batches

#: Words of a run that counts as a leak.
RUN = 10
#: Documents' windows start at every STRIDE-th word; a run of RUN words then holds a whole window.
STRIDE = 3
WINDOW = RUN - STRIDE + 1
#: Edits between a document's window and an item's that the candidates should bridge, and the recall aimed at.
EDITS, RECALL = 1, 0.9
#: Sampled positions of the walk to a key.
SAMPLED = 5
MOST_REPEATS = 16
#: Walks where words may also be inserted or deleted, which shifts the rest of a window.
MOST_REPEATS_SHIFTED = 96
#: Words of all items together that one index may hold; larger sets are refused.
MOST_WORDS = 5_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Walk:
    """One CGK random walk over windows of word numbers, and the positions of it that are sampled."""

    def __init__(self, seed: int, window: int, sampled: int):
        rng = np.random.default_rng(seed)
        self.steps = 3 * window
        k = min(sampled, 2 * window)
        self.at = np.unique(((np.arange(k) + rng.random(k)) * 2 * window / k).astype(int))  # one of each k-th part of the walk
        self.bits = rng.integers(1, 2**63 - 1, self.steps, dtype=np.int64) | 1
        self.mul = rng.integers(1, 2**63 - 1, dtype=np.int64) | 1
        self.window = window

    def keys(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Keys of the windows at ``starts``: the walk copies a word and moves on by a random bit of (step, word).

        A window ends after ``window`` words, or at ``ends`` if that comes first; past its end the walk reads zeros.
        """
        stop = starts + self.window if ends is None else np.minimum(ends, starts + self.window)
        padded = np.append(codes, 0)
        at = starts.copy()
        key = np.zeros(len(starts), dtype=np.int64)
        sampled = set(self.at.tolist())
        with np.errstate(over="ignore"):
            for j in range(int(self.at[-1]) + 1):
                inside = at < stop
                word = np.where(inside, padded[np.minimum(at, len(codes))], 0)
                if j in sampled:
                    key = (key ^ word) * self.mul
                    key ^= key >> 29
                mixed = word * self.bits[j]
                at += ((mixed >> 40) & 1) & inside
        return key


def _code(words: list[str], number: dict[str, int]) -> np.ndarray:
    """Numbers of known words, 1 for the others."""
    return np.fromiter(map(number.get, words, repeat(1)), dtype=np.int64, count=len(words))


class Index:
    """Items' windows under repeated walks, and their texts for the exact comparison."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, stride: int = STRIDE, edits: int = EDITS, recall: float = RECALL, seed: int = 8, own_only: bool = False):
        self.run, self.stride, self.own_only = run, stride, own_only
        self.window = run - stride + 1
        self.edits = edits
        texts = sorted({(i, tuple(words_of(t))) for i, t in items if i is not None})
        self.ids = [i for i, _ in texts]
        self.words = [list(w) for _, w in texts]
        if sum(map(len, self.words)) > MOST_WORDS:
            raise ValueError(f"items of more than {MOST_WORDS} words")
        rng = np.random.default_rng(seed)
        vocabulary = sorted({w for ws in self.words for w in ws})
        codes = rng.integers(2, 2**62, len(vocabulary), dtype=np.int64) | 1
        self.number = dict(zip(vocabulary, codes.tolist(), strict=True))
        self.codes = [_code(w, self.number) for w in self.words]
        owner, start = [], []
        for i, w in enumerate(self.words):
            for s in range(max(0, len(w) - self.window + 1)):
                owner.append(i)
                start.append(s)
        # runs of `run` words that stand in one item only
        seen: dict[tuple, int] = {}
        self.holders: dict[tuple, set[int]] = {}  # the texts of each run that several hold
        for i, w in enumerate(self.words):
            for g in {tuple(w[s : s + run]) for s in range(len(w) - run + 1)}:
                first = seen.setdefault(g, i)
                if first != i:
                    self.holders.setdefault(g, {first} if first >= 0 else set()).add(i)
                    seen[g] = -1
        self.unique = [[seen[tuple(w[s : s + run])] >= 0 for s in range(len(w) - run + 1)] for w in self.words]
        self.joined = [f" {' '.join(w)} " for w in self.words]
        flags = [u + [False] * (len(w) - len(u)) for u, w in zip(self.unique, self.words, strict=True)]
        self.run_own = np.array([x for f in flags for x in f], dtype=bool)
        held: dict[tuple, int] = {}
        for i, s in zip(owner, start, strict=True):
            g = tuple(self.words[i][s : s + self.window])
            held[g] = i if held.get(g, i) == i else -1
        own = [held[tuple(self.words[i][s : s + self.window])] >= 0 for i, s in zip(owner, start, strict=True)]
        self.risky = np.array([self._risky(i) for i in range(len(self.words))], dtype=bool)
        # where only an item's own runs are asked for, windows that only ever lie in words which items share tell nothing and are left out
        useful = [k for k, (i, s) in enumerate(zip(owner, start, strict=True)) if not own_only or own[k] or self.risky[i] or any(flags[i][max(0, s - self.run + self.window) : s + 1])]
        owner, start = [owner[k] for k in useful], [start[k] for k in useful]
        self.window_own = np.array([own[k] for k in useful], dtype=bool)
        self.owner, self.start = np.array(owner, dtype=np.int64), np.array(start, dtype=np.int64)
        base = np.cumsum([0, *map(len, self.words)])[:-1] if self.words else np.zeros(0, dtype=np.int64)
        self.flat = np.concatenate(self.codes) if self.codes else np.zeros(0, dtype=np.int64)
        self.places = base[self.owner] + self.start if len(owner) else np.zeros(0, dtype=np.int64)
        self.walks: list[Walk] = []
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        edited = self._edited(seed)
        wide = self.window + self.edits  # words of a stretch
        missed = np.ones(len(edited) // wide, dtype=bool)
        at = np.arange(len(missed)) * wide
        kinds = [missed] if own_only else [missed[k::3] for k in range(3)]  # replaced, inserted, deleted: each must reach the recall
        most = MOST_REPEATS if own_only else MOST_REPEATS_SHIFTED
        while not self.walks or any(m.sum() > (1 - recall) * len(m) for m in kinds):
            if len(self.walks) >= most:
                raise ValueError(f"{most} walks miss the recall of {recall}: sample fewer positions")
            walk = Walk(seed * 1000 + len(self.walks), self.window, SAMPLED)
            keys = walk.keys(self.flat, self.places)
            order = np.argsort(keys, kind="stable")
            self.walks.append(walk)
            self.tables.append((keys[order], order))
            if len(missed):
                missed &= walk.keys(edited, at) != keys[self._picked]
        self.recall = 1 - max(m.mean() for m in kinds) if len(missed) else 1.0

    def _edited(self, seed: int) -> np.ndarray:
        """Stretches that begin with windows of items with ``edits`` words replaced (else, in turn, replaced, inserted and deleted), end to end: walks are added until they find these."""
        if not self.edits or not len(self.places):
            self._picked = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.int64)
        rng = np.random.default_rng(seed + 1)
        self._picked = rng.integers(0, len(self.places), 2000)
        padded = np.append(self.flat, np.zeros(self.edits, dtype=np.int64))
        out = padded[self.places[self._picked][:, None] + np.arange(self.window + self.edits)]  # the words that follow move up after a deletion
        for _ in range(self.edits):
            where, new = rng.integers(0, self.window, len(out)), rng.integers(2, 2**62, len(out)) | 1
            for k, (i, word) in enumerate(zip(where.tolist(), new.tolist(), strict=True)):
                if not self.own_only and k % 3 == 1:
                    out[k, i + 1 :] = out[k, i:-1].copy()
                elif not self.own_only and k % 3 == 2:
                    out[k, i:-1] = out[k, i + 1 :].copy()
                    continue
                out[k, i] = word
        return out.ravel()

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (window of the document, window of an item) that collide and lie near each other, as numbers of ``starts`` and of the index."""
        pairs = []
        for walk, (keys, order) in zip(self.walks, self.tables, strict=True):
            mine = walk.keys(codes, starts)
            lo = np.searchsorted(keys, mine, "left")
            there = np.flatnonzero(lo < len(keys))
            there = there[keys[lo[there]] == mine[there]]
            if not len(there):
                continue
            hi = np.searchsorted(keys, mine[there], "right")
            n = hi - lo[there]
            rows = np.repeat(there, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(self.near(codes, starts, np.stack([rows, order[np.repeat(lo[there], n) + within]], 1)))
        if not pairs:
            return np.zeros((0, 2), dtype=np.int64)
        both = np.concatenate(pairs)
        return both[np.unique(both[:, 0] * (len(self.owner) + 1) + both[:, 1], return_index=True)[1]]

    def near(self, codes: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The candidates that can be within ``edits`` edits.

        Sound: of a window's words cut in edits + 1 parts by the edits, the longest part stands
        unchanged on a diagonal at most ``edits`` away, so at least that many words agree on one.
        """
        if not len(pairs):
            return pairs
        padded = np.append(codes, np.zeros(self.window + self.edits, dtype=np.int64))
        mine = np.append(self.flat, np.full(self.window + self.edits, -1, dtype=np.int64))
        p, q = starts[pairs[:, 0]], self.places[pairs[:, 1]]
        keep = np.zeros(len(pairs), dtype=bool)
        if self.edits < 2:  # at one edit one word differs, or those after it stand one place further or nearer
            equal = np.zeros(len(pairs), dtype=np.int16)
            head, going = np.zeros(len(pairs), dtype=np.int16), np.ones(len(pairs), dtype=bool)
            for k in range(self.window):
                same = padded[p + k] == mine[q + k]
                equal += same
                going &= same
                head += going
            keep = equal >= self.window - self.edits
            for shift in (1, -1) if self.edits and not self.own_only else ():
                tail, going = np.zeros(len(pairs), dtype=np.int16), np.ones(len(pairs), dtype=bool)
                for k in range(self.window - 1, max(0, -shift) - 1, -1):
                    going &= padded[p + k + shift] == mine[q + k]
                    tail += going
                keep |= head + tail >= self.window - (shift < 0)
            return pairs[keep]
        for shift in range(-self.edits, self.edits + 1):
            equal = np.zeros(len(pairs), dtype=np.int16)
            for k in range(max(0, -shift), self.window - max(0, shift)):
                equal += padded[p + k] == mine[q + k + shift]
            keep |= equal >= self.window // (self.edits + 1)
        return pairs[keep]

    def telling(self, codes: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The candidates that can tell of an item: the others lie in words that items share.

        Kept are windows that stand in one item only, those inside an equal run of ``run`` words
        that does, and all of the few items in which a longer run could be an item's own although
        each of its parts is shared.
        """
        if not len(pairs):
            return pairs
        keep = self.window_own[pairs[:, 1]] | self.risky[self.owner[pairs[:, 1]]]
        p, q, s = starts[pairs[:, 0]], self.places[pairs[:, 1]], self.start[pairs[:, 1]]
        padded = np.append(codes, np.zeros(self.run, dtype=np.int64))
        mine = np.append(self.flat, np.full(self.run, -1, dtype=np.int64))
        for back in range(self.run - self.window + 1):
            equal = (s >= back) & (p >= back)
            for k in range(-back, self.run - back):
                equal &= padded[np.maximum(p + k, 0)] == mine[np.maximum(q + k, 0)]
            keep |= equal & self.run_own[np.maximum(q - back, 0)]
        return pairs[keep]

    def verify(self, codes: np.ndarray, words: list[str], a: int, b: int, at: int, item: int, s: int) -> tuple[int, int, bool]:
        """Exact comparison around a candidate: (edits of the windows if within the bound else -1, longest equal run, its claim to the item).

        The run is the longest on the diagonals through the windows and their ``edits`` neighbours; it is
        the item's own if, as a run of at least ``run`` words, it stands in no other item.
        """
        best, own = 0, False
        mine = self.codes[item]
        reach = 0 if self.own_only else self.edits  # words that the document's stretch may be longer or shorter
        near = [edit_distance(codes[at : at + n], mine[s : s + self.window], self.edits) for n in range(self.window - reach, self.window + reach + 1) if at + n <= b]
        d = min((x for x in near if x >= 0), default=-1)
        for shift in range(-self.edits, self.edits + 1):
            p, q = at, s + shift
            if q < 0:
                p, q = p - q, 0
            back = min(p - a, q)
            fwd = min(b - p, len(mine) - q)
            if back + fwd < self.run:
                continue
            x, y = codes[p - back : p + fwd], mine[q - back : q + fwd]
            off = np.flatnonzero((x != y) | (x == 1))
            cut = np.concatenate([[-1], off, [len(x)]])
            for k in np.flatnonzero(np.diff(cut) > 1):
                lo, hi = int(cut[k]) + 1, int(cut[k + 1])
                n = hi - lo
                if n >= self.run:
                    i0 = q - back + lo
                    if any(self.unique[item][i0 : i0 + n - self.run + 1]) or self._alone(item, i0, n):
                        own = True
                best = max(best, n)
        return d, best, own

    def _risky(self, item: int) -> bool:
        """Whether a stretch of shared runs of the item stands as a whole in no other item."""
        u = [*self.unique[item], True]
        start = None
        for k, own in enumerate(u):
            if not own and start is None:
                start = k
            elif own and start is not None:
                if self._alone(item, start, k - start + self.run - 1):
                    return True
                start = None
        return False

    def _alone(self, item: int, start: int, n: int) -> bool:
        words = self.words[item]
        run = f" {' '.join(words[start : start + n])} "
        others = self.holders.get(tuple(words[start : start + self.run]), ())
        return not any(run in self.joined[i] for i in others if self.ids[i] != self.ids[item])


def edit_distance(a: np.ndarray, b: np.ndarray, bound: int) -> int:
    """Edit distance of two short sequences, or -1 beyond ``bound``."""
    if abs(len(a) - len(b)) > bound:
        return -1
    if len(a) == len(b) and (diff := int((a != b).sum())) <= min(bound, 1):
        return diff
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] if row[-1] <= bound else -1


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, run: int = RUN, edits: int = EDITS, own_only: bool = False) -> DataFrame:
    """``doc_id, item_id, run, edits, own``: documents with a passage of an item.

    ``run``: the longest run of equal words found; ``edits``: the least edit distance of an item's window
    to a stretch of the document (words replaced, inserted or deleted), -1 beyond the bound;
    ``own``: the document has at least ``run`` consecutive words of the item that, as a run, stand in
    no other item. Pairs whose windows lie beyond ``edits`` edits and that share no run are dropped.
    ``own_only`` leaves out what can't be ``own``: all pairs with ``own`` come out, few of the others.
    Null ids and texts and items shorter than a window match nothing; repeated items count once.
    """
    items = items.select("item_id", "text").distinct()
    if (items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) > MOST_WORDS:
        raise ValueError(f"items of more than {MOST_WORDS} words")
    got = [(r[0], r[1]) for r in items.collect()]
    index = docs.sparkSession.sparkContext.broadcast(Index(got, run=run, edits=edits, own_only=own_only))

    def make():
        ix = index.value

        def batch(ids, texts):
            words = [words_of(t) if i is not None else [] for i, t in zip(ids, texts, strict=True)]
            ends = np.cumsum([0, *map(len, words)])
            codes = _code([w for ws in words for w in ws], ix.number)
            starts = [np.arange(a, b - ix.window + 1, ix.stride) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
            starts = np.concatenate(starts) if len(starts) else np.zeros(0, dtype=np.int64)
            found: dict[tuple[int, int], list] = {}
            if len(starts) and len(ix.owner):
                pairs = ix.candidates(codes, starts)
                if ix.own_only:
                    pairs = ix.telling(codes, starts, pairs)
                doc_of, item_of = owner[pairs[:, 0]], ix.owner[pairs[:, 1]]
                at_of, s_of = starts[pairs[:, 0]], ix.start[pairs[:, 1]]
                # one comparison for each diagonal of two texts: its run is the longest on it
                diagonal = np.stack([doc_of, item_of, at_of - s_of])
                if not ix.own_only:  # windows of one diagonal differ in their edits
                    diagonal = np.concatenate([diagonal, at_of[None]])
                pick = np.unique(diagonal, axis=1, return_index=True)[1] if len(pairs) else []
                for doc, item, at, s in zip(doc_of[pick].tolist(), item_of[pick].tolist(), at_of[pick].tolist(), s_of[pick].tolist(), strict=True):
                    d, n, own = ix.verify(codes, words[doc], int(ends[doc]), int(ends[doc + 1]), at, item, s)
                    if d < 0 and n < ix.run:
                        continue
                    known = found.get((doc, item))
                    if known is None:
                        found[doc, item] = [n, d, own]
                    else:
                        known[0] = max(known[0], n)
                        known[1] = d if known[1] < 0 else known[1] if d < 0 else min(d, known[1])
                        known[2] = known[2] or own
            keys = list(found)
            return [ids[d] for d, _ in keys], [ix.ids[i] for _, i in keys], *([found[k][c] for k in keys] for c in range(3))

        return batch

    return map_batches(docs.select(docs[id_col].cast("bigint"), text_col), make, "doc_id bigint, item_id bigint, run int, edits int, own boolean", scan=True)
