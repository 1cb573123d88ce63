"""SentencePiece encoding, decoding and sampled segmentations.

encode() gives the model's own ids, decode() their text. sample() draws ``k``
distinct segmentations of a text without replacement by Gumbel top-k: every
segmentation's log-probability is perturbed by a Gumbel variable, and a best-
first search over the lattice of vocabulary pieces emits the largest first.
The search keeps a priority queue of regions (all segmentations that follow an
emitted one up to a node and leave it there). A region's bound is exact: its
largest perturbed value is a Gumbel at the log of its probability mass, which
backward sums over the lattice give, truncated at its parent's value. After k
emissions the next bound is the threshold of the inclusion probabilities
1 - exp(-exp(log p - threshold)).

Random numbers are hashes of row key, sample and position: any batching or a
rerun after a lost executor gives the same samples (sums may differ in the last
digits of a double).

A piece holds white space only in front and never a line break, nor letters and
other characters together, so the lattice is a chain of small ones, shared by
all occurrences of a word; a vocabulary for which that fails is searched whole. Piece probabilities: a unigram model's
scores are log-probabilities; a BPE model's scores are only merge ranks, and
the rank is taken as frequency by Zipf's law, p ~ 1 / (rank + 2.7). Characters
that no piece has become their byte pieces, as one edge.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from declario.llm.common import free_name, spared

SPACE = "▁"
BASE = np.uint64(0x5851F42D4C957F2D)  # of the hash of pieces
EDGES = 2_000_000  # with more edges a worker forgets its less used words
CHARS = 400_000  # texts are searched together up to so many characters
LEARNED = 16384  # words learned at once
BITS = 17  # of the tables that say which hashes of pieces there may be
SLOTS = 20  # bits of the table that finds a word by its hash


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stream(key: np.ndarray, salt: int) -> np.ndarray:
    """A row key's state for a salt; GOLDEN times a position is to be added."""
    with np.errstate(over="ignore"):
        return key + np.uint64(salt) * np.uint64(0xD1342543DE82EF95) + GOLDEN


def draw(x: np.ndarray) -> np.ndarray:
    """In (0, 1): a hash of the state, which is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def uniform(key: np.ndarray, salt: int, at: np.ndarray) -> np.ndarray:
    """In (0, 1): a hash of row key, salt and position."""
    with np.errstate(over="ignore"):
        return draw(stream(key, salt) + at.astype(np.uint64) * GOLDEN)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def largest(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` largest ``x`` of each group, ties to the first; groups stand together."""
    x, out = x.copy(), []
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, len(group)))
    for _ in range(min(k, sizes.max(initial=0))):
        most = np.maximum.reduceat(x, first)
        hit = np.flatnonzero(x == np.repeat(np.where(most > -np.inf, most, np.nan), sizes))
        hit = hit[np.diff(group[hit], prepend=-1) > 0]
        out.append(hit)
        x[hit] = -np.inf
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Lattices:
    """The words seen so far, as one array of edges by start node, longest first.

    ``share`` of an edge is the probability of leaving its node by it or an
    earlier one. The longest piece is mostly the likeliest, so a random edge is
    found in few steps from the first.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model, num_threads=1)  # a worker has one core
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in ids}
        self.longest = max(map(len, self.piece))
        scores = {i: sp.get_score(i) for i in ids}
        if min(scores.values()) < -1000:
            order = sorted(ids, key=lambda i: (-scores[i], i))
            scores = {i: -float(np.log(r + 2.7)) for r, i in enumerate(order)}
        self.logp = scores
        self.lowest = min(scores.values())
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece)
        self.kind = self.kinds()
        self.power = np.ones(1, np.uint64)
        self.by_id = np.full(sp.get_piece_size(), self.lowest)
        self.by_id[list(scores)] = list(scores.values())
        self.by_length, self.at, self.begun = {}, {}, {}
        self.bytes = {i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        for n in {len(p) for p in self.piece}:
            own = [p for p in self.piece if len(p) == n]
            c = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            c = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            c ^= c >> np.uint64(29)
            h = np.zeros(len(own), np.uint64)
            for i in range(n):
                h = h * BASE + c[:, i]
                self.begun.setdefault(i + 1, np.zeros(1 << BITS, bool))[h >> np.uint64(64 - BITS)] |= i + 1 < n
            order = np.argsort(h)
            h, slot = h[order], (h[order] >> np.uint64(64 - BITS)).astype(np.int64)
            self.by_length[n] = h, np.array([self.piece[p] for p in own])[order]
            self.at[n] = np.full(1 << BITS, -1, np.int32)  # by the top bits of the hash: the first piece with them
            self.at[n][slot[::-1]] = np.arange(len(h))[::-1]
        self.skip_ids = sp.encode("\n")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.forget()

    def kinds(self) -> np.ndarray:
        """Kind of every character: line break, mark of a space, and if the vocabulary
        keeps them apart, letters and all others. No piece reaches over a change of
        kind, but that a space goes with what follows it."""
        out = np.full(0x110000, 3, np.uint8)
        if self.apart:
            inner = [p.lstrip(SPACE) for p in self.piece]
            letter = re.compile(r"[^\W\d_]").fullmatch
            mixed = lambda p, odd: len({bool(letter(c)) and c not in odd for c in p}) > 1
            odd = {c for p in inner if mixed(p, "") for c in p if letter(c) and not c.isalpha()}
            if not any(mixed(p, odd) for p in inner):
                every = "".join(map(chr, range(0x110000)))
                for run in re.finditer(r"[^\W\d_]+", every):
                    out[run.start() : run.end()] = 2
                out[[ord(c) for c in odd]] = 3
            out[ord("\n")], out[ord(SPACE)] = 0, 1
        return out

    def words(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the stretches that no piece reaches over; ``begins``: where texts do."""
        kind = self.kind[codes]
        fresh = np.empty(len(codes), bool)
        before = kind[:-1]
        fresh[1:] = (kind[1:] == 0) | (before == 0) | ((kind[1:] != before) & (before != 1))
        fresh[begins] = True
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(codes)))
        if size.max() > len(self.power):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), BASE)), dtype=np.uint64)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= self.power[np.arange(len(codes)) - np.repeat(start, size)]
        h = np.add.reduceat(mixed, start) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return start, h

    def numbers(self, text: str, start: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of the words at ``start``; those not seen yet are learned."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.slot[slot]
        lost = np.flatnonzero((out < 0) | (self.hash[out] != h)) if len(self.hash) else np.arange(len(h))
        if len(lost):
            own, first, inverse = np.unique(h[lost], return_index=True, return_inverse=True)
            number = np.array([self.number.get(x, -1) for x in own.tolist()], np.int64)
            if len(new := np.flatnonzero(number < 0)):
                number[new] = len(self.hash) + np.arange(len(new))
                ends = np.append(start, len(text))
                for i in range(0, len(new), LEARNED):
                    some = new[i : i + LEARNED]
                    at = lost[first[some]]
                    self.learn([text[x:y] for x, y in zip(start[at].tolist(), ends[at + 1].tolist(), strict=True)], own[some])
            out[lost] = number[inverse]
            self.slot[slot[lost]] = out[lost]
        return out

    def forget(self, least: int = 0) -> None:
        """Drop words but for the most used, up to ``least`` edges."""
        if not least:
            self.number: dict[int, int] = {}  # by hash
            self.hash, self.uses = np.empty(0, np.uint64), np.empty(0, np.int64)
            self.slot = np.full(1 << SLOTS, -1, np.int64)
            self.word_at, self.word_size = (np.empty(0, np.int64) for _ in range(2))  # by word: first node, nodes
            self.n_nodes = 0
            self.room: dict[str, np.ndarray] = {}
            self.put(0, logq=np.empty(0), share=np.empty(0), step=np.empty(0, np.int32), n_ids=np.empty(0, np.int8))
            self.put(0, id_at=np.empty(0, np.int32), ids=np.empty(0, np.int32))
            self.first = np.zeros(1, np.int64)  # of each node, its first edge
            self.own_at, self.own_n, self.own = (np.empty(0, np.int64) for _ in range(3))  # the model's ids, by word
            return
        edges = self.first[self.word_at + self.word_size] - self.first[self.word_at]
        order = np.argsort(-self.uses, kind="stable")
        keep = np.sort(order[np.cumsum(edges[order]) <= least])
        edge = spread(self.first[self.word_at[keep]], edges[keep])
        node = spread(self.word_at[keep], self.word_size[keep])
        degree = self.first[node + 1] - self.first[node]
        ids = spread(self.id_at[edge], self.n_ids[edge])
        own = spread(self.own_at[keep], self.own_n[keep])
        self.put(0, logq=self.logq[edge], share=self.share[edge], step=self.step[edge], n_ids=self.n_ids[edge], ids=self.ids[ids])
        self.put(0, id_at=np.cumsum(self.n_ids) - self.n_ids)
        self.first = np.append(0, np.cumsum(degree))
        self.own, self.own_n = self.own[own], self.own_n[keep]
        self.own_at = np.cumsum(self.own_n) - self.own_n
        self.word_size = self.word_size[keep]
        self.word_at, self.n_nodes = np.cumsum(self.word_size) - self.word_size, len(node)
        self.hash, self.uses = self.hash[keep], self.uses[keep] // 2
        self.number = dict(zip(self.hash.tolist(), range(len(keep)), strict=True))
        self.slot = np.full(1 << SLOTS, -1, np.int64)
        self.slot[(self.hash >> np.uint64(64 - SLOTS)).astype(np.int64)] = np.arange(len(keep))

    def own_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of all words in a row, and how many each has.

        Words are encoded some hundred at a time, a line break in front of each:
        no piece reaches over one.
        """
        line = self.skip_ids[-1]
        if not self.apart or line not in self.bytes:
            each = self.sp.encode([w[1:].replace(SPACE, " ") for w in words])
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
        said = ["" if w == "\n" else w.replace(SPACE, " ") for w in words]
        parts = ["\n" + "\n".join(said[i : i + 200]) for i in range(0, len(said), 200)]
        lead = len(self.skip_ids) - 1
        flat = np.fromiter(chain.from_iterable(x[lead:] for x in self.sp.encode(parts)), np.int32)
        heads = np.flatnonzero(flat == line)
        sizes = np.diff(np.append(heads, len(flat))) - 1
        flat = np.delete(flat, heads)
        if "\n" in words:  # the break itself
            k = words.index("\n")
            flat, sizes[k] = np.insert(flat, sizes[:k].sum(), line), 1
        return flat, sizes

    def edges_of(self, codes: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece id) of the pieces in the words, by start, longest first.
        ``dist``: characters to the word's end. Id -1: a character that no piece has."""
        start, length, ids = [], [], []
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h, at = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        for n in range(1, self.longest + 1):
            if n > 1:  # only where some piece may still begin so
                live = self.begun[n - 1][h >> np.uint64(64 - BITS)] & (dist[at] >= n)
                at, h = at[live], h[live]
            if not len(at):
                break
            h = h * BASE + mixed[at + n - 1]
            known, of = self.by_length.get(n, (None, None))
            if known is None:
                continue
            k = self.at[n][h >> np.uint64(64 - BITS)]
            maybe = np.flatnonzero(k >= 0)
            k, own = k[maybe], h[maybe]
            hit = known[k] == own
            if len(behind := np.flatnonzero(known[k] < own)):  # another piece may have these bits too
                k[behind] = np.minimum(np.searchsorted(known, own[behind]), len(known) - 1)
                hit[behind] = known[k[behind]] == own[behind]
            if n == 1:
                start.append(at)
                ids.append(np.full(len(at), -1))
                ids[-1][maybe[hit]] = of[k[hit]]
            else:
                start.append(at[maybe[hit]])
                ids.append(of[k[hit]])
            length.append(np.full(len(start[-1]), n))
        start, length, ids = (np.concatenate(x[::-1]) for x in (start, length, ids))
        order = np.argsort(start, kind="stable")
        return start[order], length[order], ids[order]

    def put(self, at: int | None, **arrays: np.ndarray) -> None:
        """Write ``arrays`` from place ``at`` on (None: behind what there is), in room that is kept."""
        for name, x in arrays.items():
            begin = len(getattr(self, name)) if at is None else at
            room = self.room.get(name)
            if room is None:
                room = np.empty(EDGES + EDGES // 8, x.dtype)  # pages that aren't written take no memory
            if begin + len(x) > len(room):
                room = np.concatenate([room[:begin], np.empty(len(x) + len(room) // 2, room.dtype)])
            room[begin : begin + len(x)] = x
            self.room[name] = room
            setattr(self, name, room[: begin + len(x)])

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        dist = np.repeat(ends, size) - np.arange(len(codes))
        start, length, ids = self.edges_of(codes, dist)
        logp = np.where(ids < 0, self.lowest - 10.0, self.by_id[ids])
        # sums from behind, on nodes with one more behind each word, whose sum is 0
        node = start + np.repeat(np.arange(len(words)), size)[start]
        back = np.zeros(len(codes) + len(words))
        order = np.argsort(dist[start].astype(np.int16) if dist.max() < 1 << 15 else dist[start], kind="stable")
        own, score = node[order], logp[order]
        ahead = own + length[order]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(np.append(heads, len(own)))
        at = np.searchsorted(dist[start[order[heads]]], np.arange(1, dist.max() + 2)).tolist()
        heads_ = [*heads.tolist(), len(own)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            low, high = heads_[i], heads_[j]
            x = score[low:high] + back[ahead[low:high]]
            first = heads[i:j] - low
            most = np.maximum.reduceat(x, first)
            x = np.exp(x - np.repeat(most, sizes[i:j]))
            back[own[heads[i:j]]] = most + np.log(np.add.reduceat(x, first))
        logq = np.minimum(logp + back[node + length] - back[node], 0.0)
        counts = np.bincount(start, minlength=len(codes))
        ends_at = np.cumsum(counts)
        first = ends_at - counts
        q = np.exp(logq)
        total = np.cumsum(q)
        total -= np.repeat(total[first] - q[first], counts)
        np.minimum(total, 1.0, out=total)
        total[ends_at - 1] = 1.0
        n_ids = np.ones(len(ids), np.int32)
        lost = np.flatnonzero(ids < 0)
        own = {int(c): self.bytes_of(chr(c)) for c in np.unique(codes[start[lost]])}
        n_ids[lost] = [len(own[c]) for c in codes[start[lost]].tolist()]
        flat = np.repeat(ids, n_ids).astype(np.int32)
        if len(lost):
            flat[flat < 0] = np.concatenate([own[c] for c in codes[start[lost]].tolist()])
        self.put(None, id_at=len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids=n_ids, logq=logq, share=total, step=length)
        self.put(None, ids=flat)
        edge = self.first[-1]
        self.first = np.concatenate([self.first[:-1], edge + first, [edge + len(start)]])
        own, sizes = self.own_ids(words)
        self.own_at = np.concatenate([self.own_at, len(self.own) + np.cumsum(sizes) - sizes])
        self.own_n = np.concatenate([self.own_n, sizes])
        self.own = np.concatenate([self.own, own])
        self.number.update(zip(hashes.tolist(), range(len(self.hash), len(self.hash) + len(words)), strict=True))
        self.hash, self.uses = np.concatenate([self.hash, hashes]), np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.word_at = np.concatenate([self.word_at, self.n_nodes + ends - size])
        self.word_size = np.concatenate([self.word_size, size])
        self.n_nodes += len(codes)

    def bytes_of(self, c: str) -> np.ndarray:
        ids = [self.byte[b] for b in c.encode()]
        return np.array(ids if self.bytes.issuperset(ids) else [self.sp.unk_id()], np.int32)


class Batch:
    """Texts searched together. Positions are characters of all texts in a row."""

    def __init__(self, lat: Lattices, texts: list[str], keys: np.ndarray):
        if len(lat.step) > EDGES:
            lat.forget(EDGES // 2)
        text = "".join(SPACE + t.replace(" ", SPACE) for t in texts if t)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.to = np.cumsum(lengths)
        self.from_ = self.to - lengths
        self.lat, self.n, self.total, self.keys = lat, len(texts), len(text), keys
        if text:
            self.start, h = lat.words(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.from_[lengths > 0])
            self.word = lat.numbers(text, self.start, h)
        else:
            self.start = self.word = np.empty(0, np.int64)
        lat.uses += np.bincount(self.word, minlength=len(lat.uses))
        self.base, self.size = lat.word_at[self.word], lat.word_size[self.word]
        self.words_to = np.searchsorted(self.start, self.to)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.words_to, prepend=0))

    def own_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of all texts in a row, and where each text ends."""
        counts = self.lat.own_n[self.word]
        ids = self.lat.own[spread(self.lat.own_at[self.word], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], self.words_to])]

    def walk(self, path: np.ndarray, which: np.ndarray, offset: np.ndarray, salt: int) -> None:
        """Random edges for words ``which``, each from its ``offset`` on, into ``path``."""
        lat = self.lat
        at, ends = self.start[which] + offset, self.start[which] + self.size[which]
        node = self.base[which] + offset
        state = (stream(self.keys, salt) - self.from_.astype(np.uint64) * GOLDEN)[self.doc[which]]
        live = at < ends
        while True:
            if not live.all():
                live = np.flatnonzero(live)
                at, ends, node, state = at[live], ends[live], node[live], state[live]
            if not len(at):
                break
            u = draw(state + at.astype(np.uint64) * GOLDEN)
            edge = lat.first[node]
            more = np.flatnonzero(lat.share[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[lat.share[edge[more]] <= u[more]]
            path[at] = edge
            step = lat.step[edge]
            at += step
            node += step
            live = at < ends

    def sample(self, k: int) -> list[list[tuple]]:
        """Per text up to ``k`` of (edges, log p, perturbed), best first, then the threshold."""
        lat, n = self.lat, self.n
        found: list[list] = [[] for _ in range(n)]
        queue: list[list] = [[] for _ in range(n)]
        paths: list[np.ndarray] = []
        live = np.flatnonzero(self.to > self.from_)
        at0 = np.zeros(n, np.int64)
        value = -np.log(-np.log(uniform(self.keys, 0, at0)))
        fork = {int(d): (int(self.from_[d]), 0.0, (), -1) for d in live}  # position, log p before, edges excluded, edge
        for s in range(1, k + 1):
            path = np.full(self.total, -1, np.int32)
            offset = np.full(len(self.size), -1, np.int64)
            for d, (at, _, _, edge) in fork.items():
                low, high = (self.words_to[d - 1] if d else 0), self.words_to[d]
                w = low
                if edge >= 0:
                    parent = paths[queue_parent[d]]
                    path[self.from_[d] : at] = parent[self.from_[d] : at]
                    path[at] = edge
                    w = low + int(np.searchsorted(self.start[low:high], at, side="right")) - 1
                    offset[w] = at + lat.step[edge] - self.start[w]
                    w += 1
                offset[w:high] = 0
            which = np.flatnonzero(offset >= 0)
            self.walk(path, which, offset[which], s)
            paths.append(path)
            places = np.flatnonzero(path >= 0)
            edges = path[places]
            logq = lat.logq[edges]
            sums = np.concatenate([[0.0], np.cumsum(logq)])
            chosen = np.array(sorted(fork), np.int64)
            if not len(chosen):
                break
            low = np.searchsorted(places, self.from_[chosen])
            high = np.searchsorted(places, self.to[chosen])
            sizes = high - low
            before = sums[:-1] - np.repeat(sums[low], sizes)
            total = sums[high] - sums[low]
            for i, d in enumerate(chosen):
                found[d].append((edges[low[i] : high[i]], float(total[i]), float(value[d])))
            begin = np.array([fork[int(d)][0] for d in chosen])
            # Noise spans less than 41 nats, so a region 60 below the best of its path can't
            # come before it, nor one whose prefix is 80 below that of the first free place
            # (the regions between have nearly all mass). Texts that have too few regions
            # within that are looked at whole.
            head = np.searchsorted(places, begin)
            ahead = np.repeat(before[np.minimum(head + 1, high - 1)], sizes)
            every, wanted = places >= np.repeat(begin, sizes), k - s + 1
            part, whole = before > ahead - 80, np.zeros(len(chosen), bool)
            while True:
                near = np.flatnonzero(every & part)
                own = np.repeat(np.arange(len(chosen)), sizes)[near]
                where = before[near] + self.log_rest(chosen, fork, own, places[near], edges[near])
                first = np.flatnonzero(np.diff(own, prepend=-1))
                most = np.repeat(np.maximum.reduceat(where, first), np.diff(np.append(first, len(own))))
                live = np.flatnonzero((where > -np.inf) & ((where >= most - 60) | whole[own]))
                few = (np.bincount(own[live], minlength=len(chosen)) < wanted) & ~whole
                if not few.any():
                    break
                whole |= few
                part |= np.repeat(few, sizes)
            own, near, where = own[live], near[live], where[live]
            places, edges, before = places[near], edges[near], before[near]
            noise = -np.log(uniform(self.keys[chosen][own], 1000 + s, places - self.from_[chosen][own]))
            bound = where - np.log(np.exp(np.minimum(where - value[chosen][own], 700.0)) + noise)
            for i in largest(bound, own, wanted).tolist():  # of each path no more regions can be needed
                d, at = int(chosen[own[i]]), int(places[i])
                gone = fork[d][2] if at == fork[d][0] else ()
                heapq.heappush(queue[d], (-float(bound[i]), s - 1, at, float(before[i]), (*gone, int(edges[i]))))
            if s == k:
                break
            popped = {d: heapq.heappop(queue[d]) for d in map(int, chosen) if queue[d]}
            edge = self.others(list(popped), [x[2] for x in popped.values()], [x[4] for x in popped.values()], s + 1)
            fork = {d: (x[2], x[3], x[4], e) for (d, x), e in zip(popped.items(), edge, strict=True)}
            queue_parent = {d: x[1] for d, x in popped.items()}
            for d, x in popped.items():
                value[d] = -x[0]
        for d in range(n):
            found[d].append(-queue[d][0][0] if queue[d] else -np.inf)
        return found

    def log_rest(self, chosen: np.ndarray, fork: dict, own: np.ndarray, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Log probability of leaving paths ``own`` at places ``at`` by another edge than ``edge``."""
        lat = self.lat
        rest = 1.0 - np.exp(lat.logq[edge])
        begin = np.array([fork[int(d)][0] for d in chosen])
        gone = {int(i): x for i in np.flatnonzero(at == begin[own]) if (x := fork[int(chosen[own[i]])][2])}
        small = rest < 1e-4
        small[list(gone)] = True
        small = np.flatnonzero(small)
        w = np.searchsorted(self.start, at[small], side="right") - 1
        node = self.base[w] + at[small] - self.start[w]
        degree = lat.first[node + 1] - lat.first[node]
        rest[small] = 0.0
        small, node, degree = (x[degree > 1] for x in (small, node, degree))
        if len(small):  # the other edges themselves, for 1 - q would be rounded away
            mass = np.exp(lat.logq[spread(lat.first[node], degree)])
            heads = np.cumsum(degree) - degree
            mass[heads + edge[small] - lat.first[node]] = 0.0
            for j in np.flatnonzero(np.isin(small, list(gone))):
                mass[heads[j] + np.array(gone[int(small[j])]) - lat.first[node[j]]] = 0.0
            rest[small] = np.add.reduceat(mass, heads)
        with np.errstate(divide="ignore"):
            return np.log(rest)

    def others(self, docs: list[int], at: list[int], gone: list[tuple], salt: int) -> list[int]:
        """For each text a random edge of its node at ``at`` that isn't among ``gone``."""
        if not docs:
            return []
        lat, d, at = self.lat, np.array(docs), np.array(at)
        w = np.searchsorted(self.start, at, side="right") - 1
        node = self.base[w] + at - self.start[w]
        sizes = lat.first[node + 1] - lat.first[node]
        edges = spread(lat.first[node], sizes)
        ends = np.cumsum(sizes)
        odds = np.exp(lat.logq[edges])
        for i, out in enumerate(gone):
            odds[ends[i] - sizes[i] + np.array(out) - lat.first[node[i]]] = 0.0
        upto = np.cumsum(odds)
        low = upto[ends - sizes] - odds[ends - sizes]
        want = low + uniform(self.keys[d], 2000 + salt, at - self.from_[d]) * (upto[ends - 1] - low)
        hit = np.searchsorted(upto, want, side="right")
        last = np.maximum.accumulate(np.where(odds > 0, np.arange(len(odds)), 0))[ends - 1]
        return edges[np.minimum(hit, last)].tolist()

    def ids(self, edges: np.ndarray) -> np.ndarray:
        return self.lat.ids[spread(self.lat.id_at[edges], self.lat.n_ids[edges])]

    def id_lists(self, paths: list[np.ndarray]) -> pa.Array:
        """The ids of each path."""
        lat, flat = self.lat, np.concatenate([*paths, np.empty(0, np.int64)])
        counts = lat.n_ids[flat]
        ends = np.append(0, np.cumsum(counts))[np.cumsum([0, *map(len, paths)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lat.ids[spread(lat.id_at[flat], counts)], pa.int32()))


SAMPLES = T.ArrayType(
    T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("logp", T.DoubleType()),
            T.StructField("perturbed", T.DoubleType()),
            T.StructField("log_inclusion", T.DoubleType()),
        ]
    )
)
PIECES = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
        T.StructField("samples", SAMPLES),
    ]
)


def log_inclusion(logp: float, threshold: float) -> float:
    """log(1 - exp(-exp(logp - threshold))); 0 where all segmentations were emitted."""
    x = logp - threshold
    return 0.0 if x > 30 else float(x if x < -30 else np.log(-np.expm1(-np.exp(x))))


def encode_batch(lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> pa.StructArray:
    b = Batch(lat, texts, keys)
    own, ends = b.own_ids()
    back = lat.sp.decode([own[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)]) if texts else []
    paths, numbers, upto = [], [], [0]
    for *found, threshold in b.sample(k) if k else ([-np.inf] for _ in texts):
        for edges, logp, value in found:
            paths.append(edges)
            numbers.append((logp, value, log_inclusion(logp, threshold)))
        upto.append(len(paths))
    cols = np.array(numbers, np.float64).reshape(-1, 3)
    samples = pa.StructArray.from_arrays(
        [b.id_lists(paths), *(pa.array(cols[:, i]) for i in range(3))], names=["ids", "logp", "perturbed", "log_inclusion"]
    )
    first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.astype(np.int32)))
    same = pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())
    listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), samples)
    return pa.StructArray.from_arrays([first, same, listed], names=["ids", "round_trip", "samples"])


@lru_cache(1)
def lattices(model: bytes) -> Lattices:
    """One for each worker, which keeps the model from task to task, but no words."""
    return Lattices(model)


def _encoder(model, text_at: int, key_at: int, k: int, keep_text: bool, out: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model.value)
        lat.forget()  # a task that ends early leaves its words
        for b in batches:
            sizes = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(b.column(text_at)), 0))])
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHARS, side="right")) - 1)
                part = b.slice(at, to - at)
                at = to
                texts = [x or "" for x in part.column(text_at).to_pylist()]
                keys = np.array([xxhash.xxh3_64_intdigest(str(x)) for x in part.column(key_at).to_pylist()], np.uint64)
                cols = [c for i, c in enumerate(part.columns) if keep_text or i != text_at]
                names = [c for i, c in enumerate(part.schema.names) if keep_text or i != text_at]
                yield pa.RecordBatch.from_arrays([*cols, encode_batch(lat, texts, keys, k)], names=[*names, out])
        lat.forget()

    return spared(encode)


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "pieces",
    k: int = 2,
    model_path: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with a struct ``out``: the model's ids, whether they decode to the
    text exactly, and up to ``k`` sampled segmentations, most perturbed first.

    The model file is read once on the driver (half a megabyte; a model over
    64 MB is refused) and broadcast. Defined results: null and empty texts have
    no ids and no samples and round-trip to the empty text; a text with fewer
    segmentations than ``k`` gives all of them with log_inclusion 0; rows with
    the same key and text give the same samples; a null key is the key "None";
    a text that holds the model's own white-space mark doesn't round-trip.
    """
    data = Path(model_path or default_model()).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("the model is over 64 MB")
    out = free_name(docs, out)
    model = docs.sparkSession.sparkContext.broadcast(data)
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if keep_text or f.name != text]
    kind = T.StructType([*fields, T.StructField(out, PIECES)])
    at = (docs.columns.index(text), docs.columns.index(key))
    return docs.mapInArrow(_encoder(model, *at, k, keep_text, out), kind)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``rows`` with the text of an array of ids; null ids decode to null."""
    model = rows.sparkSession.sparkContext.broadcast(Path(model_path or default_model()).read_bytes())
    at = rows.columns.index(ids)
    out = free_name(rows, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for b in batches:
            texts = [None if x is None else sp.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    return rows.mapInArrow(spared(run), T.StructType([*fields, T.StructField(out, T.StringType())]))
