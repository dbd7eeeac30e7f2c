"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous merging of ragged arrays.

A text is cut where no merge can reach: before every run of word marks that follows
something else, and around characters that no longer piece contains.  The distinct
cuts of a batch lie one after the other in flat numpy arrays (symbols, and the rank of
each symbol with its right neighbour).  Every round takes the lowest rank of each
sequence, merges its occurrences from left to right at once, and looks up only the
pairs that changed; sequences without a pair left are counted and leave the arrays.

A vocabulary may hold pieces that rank before one of their parts.  Then a merge can
open a pair that has to be merged before the next occurrence of the current one: of
several occurrences, those behind the first such one wait for the next round.

Runs of word marks are counted by rule: their pieces rank behind all others, equally,
and are merged from the left, so a run is cut into full pieces of the longest kind and
a rest whose count is tabulated.

Cases: null and empty texts have no tokens; unknown characters count their bytes; the
strings of control pieces are ordinary text; texts are counted whole, of any length.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from strandwork.llm.texts import pieces, weight

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Bytes of distinct cuts that a worker remembers; the memory is emptied when full and at the end of a task.
REMEMBERED = 48 << 20
SLOT_BITS = 19
LIMIT = 4096


class Vocabulary:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not any(k(i) for k in kinds)}
        runs = [len(p) for p in score if set(p) == {MARK}]
        self.longest = max(runs, default=1)
        self.rest = np.array([self._run_tokens(k, set(runs)) for k in range(self.longest + 1)])
        word_scores = [s for p, s in score.items() if len(p) > 1 and set(p) != {MARK}]
        run_scores = {s for p, s in score.items() if len(p) > 1 and set(p) == {MARK}}
        if (self.rest[-1] != 1 or any(MARK in p[1:] and set(p) != {MARK} for p in score)
                or len(run_scores) > 1 or max(run_scores, default=-np.inf) >= min(word_scores)):
            raise ValueError("the vocabulary joins words, or ranks runs of word marks in another way")
        self.ids = {p: i for i, p in enumerate(score)}
        self.rest[-1] = 0  # as a remainder there is none
        # Unknown characters get numbers from here on: they never merge, whatever they are.
        self.unknown = len(self.ids)
        joins = [(self.ids[p[:k]], self.ids[p[k:]], self.ids[p], -s) for p, s in score.items() if set(p) != {MARK}
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, merged, cost = (np.array(x) for x in zip(*joins))
        keys = left.astype(np.int64) << 32 | right
        self._fill(keys, np.unique(cost, return_inverse=True)[1], merged)
        self.symbol_of = np.full(0x110000, self.unknown, np.int32)
        single = [p for p in self.ids if len(p) == 1]
        self.symbol_of[[ord(p) for p in single]] = [self.ids[p] for p in single]
        inside = {c for p in score if len(p) > 1 for c in p} - {MARK}
        # A loose character is a cut of its own, with the word marks before it.
        self.cut = re.compile(f"{MARK}*(?:[{re.escape(''.join(sorted(inside)))}]+|[^{MARK}])|{MARK}+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def _run_tokens(k: int, sizes: set[int]) -> int:
        """Tokens of a run of ``k`` marks: always the leftmost pair that makes a piece."""
        run = [1] * k
        while joins := [i for i in range(len(run) - 1) if run[i] + run[i + 1] in sizes]:
            run[joins[0] : joins[0] + 2] = [run[joins[0]] + run[joins[0] + 1]]
        return len(run)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table of the pairs; a lookup probes as many neighbours as the fullest place needed."""
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.ranks, self.merged = np.full(1 << SLOT_BITS, NONE, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slots(keys[left]) + self.probes & (1 << SLOT_BITS) - 1
            free = left[self.keys[slot] == -1]
            at = self._slots(keys[free]) + self.probes & (1 << SLOT_BITS) - 1
            at, first = np.unique(at, return_index=True)
            taken = free[first]
            self.keys[at], self.ranks[at], self.merged[at] = keys[taken], ranks[taken], merged[taken]
            left, self.probes = np.setdiff1d(left, taken), self.probes + 1

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; ``NONE`` where the vocabulary does not join them."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slots(key)
        for probe in range(1, self.probes):
            wrong = np.flatnonzero(self.keys[slot] != key)
            wrong = wrong[self.keys[slot[wrong]] != -1]
            if not len(wrong):
                break
            slot[wrong] = slot[wrong] + 1 & (1 << SLOT_BITS) - 1
        hit = self.keys[slot] == key
        return np.where(hit, self.ranks[slot], NONE), self.merged[slot]

    def merged_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word (no empty ones), and whether the first of them is a lone word mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        unknown = self.unknown
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbol_of[codes]
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        # The bytes of an unknown character are tokens each; the character itself stays one symbol.
        extra = np.add.reduceat(np.where(symbol == unknown, width - 1, 0), np.cumsum(lengths) - lengths)
        count = np.zeros(len(words), np.int64)
        lone = np.zeros(len(words), bool)
        mark = self.ids[MARK]
        owner = np.arange(len(words))
        start = np.cumsum(lengths) - lengths
        last = np.zeros(len(symbol), bool)
        last[start + lengths - 1] = True
        rank, into = self.pairs(symbol, np.append(symbol[1:], 0))
        rank[last] = NONE
        while len(owner):
            low = np.minimum.reduceat(rank, start)
            over = low == NONE
            if over.any():
                count[owner[over]] = lengths[over]
                lone[owner[over]] = symbol[start[over]] == mark
                keep = np.repeat(~over, lengths)
                symbol, last, rank, into = symbol[keep], last[keep], rank[keep], into[keep]
                owner, lengths, low = owner[~over], lengths[~over], low[~over]
                start = np.cumsum(lengths) - lengths
                if not len(owner):
                    break
            sequence = np.repeat(np.arange(len(owner)), lengths)
            at = np.flatnonzero(rank == low[sequence])
            at = self._in_turn(at, sequence, symbol, last, into, low)
            symbol[at] = into[at]
            last[at] |= last[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(sequence[at], minlength=len(owner))
            at = at - np.arange(len(at))
            symbol, last, rank, into = symbol[keep], last[keep], rank[keep], into[keep]
            start = np.cumsum(lengths) - lengths
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed], into[changed] = self.pairs(symbol[changed], np.append(symbol, 0)[changed + 1])
            rank[last] = NONE
        return count + extra, lone

    def _in_turn(self, at, sequence, symbol, last, into, low) -> np.ndarray:
        """Of the occurrences ``at``, those to merge now: not overlapping, and none behind one that opens an earlier pair."""
        if len(at) > 1:
            # Overlapping ones stand in runs of neighbours; every second of a run is taken.
            head = np.append(True, (np.diff(at) > 1) | (np.diff(sequence[at]) > 0))
            place = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[place % 2 == 0]
        seq = sequence[at]
        if (np.diff(seq) > 0).all():
            return at
        piece, floor = into[at], low[seq]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        joined = np.zeros(len(symbol), bool)
        joined[at] = True
        left = np.where(joined[np.maximum(at - 2, 0)] & (at >= 2), piece, symbol[before])
        opens_left = (self.pairs(left, piece)[0] <= floor) & (at > 0) & (sequence[before] == seq)
        opens_right = (self.pairs(piece, symbol[after])[0] <= floor) & ~last[np.minimum(at + 1, len(last) - 1)]
        opens = opens_left | opens_right
        earlier = np.cumsum(opens) - opens
        first = np.searchsorted(seq, seq)
        return at[earlier == earlier[first]]

    def learn(self, new: list[str]) -> None:
        """Count new cuts: the last mark of a run goes with the word behind it, if that takes it."""
        words = [cut.lstrip(MARK) for cut in new]
        marks = np.array([len(cut) - len(word) for cut, word in zip(new, words)])
        count, lone = self.merged_counts([MARK + word if m or not word else word for m, word in zip(marks.tolist(), words)])
        left = np.maximum(marks - 1, 0) + lone
        total = count - lone + left // self.longest + self.rest[left % self.longest]
        self.known.update(zip(new, total.tolist()))
        self.held += sum(map(weight, new))

    def counts(self, texts: list[str]) -> list[int]:
        if self.held > REMEMBERED:
            self.forget()
        cuts = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        fresh = [c for c in set(chain.from_iterable(cuts)) if c not in known]
        if fresh:
            self.learn(fresh)
        get = known.__getitem__
        return [sum(map(get, c)) for c in cuts]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker and model."""
    return Vocabulary(path)


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``model`` is a path that every executor has."""

    def run(batches):
        for part, texts in pieces(batches):
            n = np.array(vocabulary(model).counts(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"])
        vocabulary(model).forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(
        run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
