"""SentencePiece encoding and decoding on a lattice of pieces.

Words of a batch are encoded together, as columns: their substrings, up to the longest piece, are joined with the
pieces by equality (a walk through the pieces' trie, for all starts at a time); the hits are the edges of a lattice,
grouped by word and ordered by their end; a Viterbi fold goes through the ends and keeps one edge for each place.

For models of scores the kept edge is that of the best sum. For models of merges it is the one that merges
leave beside the edge kept at its start: a word's merges end in the one path of its lattice whose every
two neighbours, encoded by themselves, stay as they are. lattice.py has the same as relations.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import tokens as T
from tidewater.llm.common import small_batches

MARK = "▁"
#: Bytes of text that are encoded together, and of words that share a lattice.
CHUNK = 1 << 18
#: Slots of a worker's memories of words (with at most so many bytes and ids) and of pairs: fixed arrays, some 30 MB.
WORD_SLOTS, WORD_BYTES, WORD_IDS = 1 << 18, 16, 10
PAIR_SLOTS = 1 << 20
#: Longer words are merged one by one, n log n steps, as the fold takes a step for each place of the longest word.
LONG = 400
NEVER = np.int64(1 << 40)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


@dataclass(frozen=True)
class Pieces:
    """A model file's pieces, by id, and what its normalizer and trainer specs say of encoding."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    merges: bool  # byte pair merges; else the best path by score
    dummy_prefix: bool

    @functools.cached_property
    def table(self) -> dict[str, tuple[float, int]]:
        return {n: (s, i) for i, (n, s, k) in enumerate(zip(self.names, self.scores, self.kinds, strict=True)) if k in (NORMAL, USER)}

    @functools.cached_property
    def score_of(self) -> dict[str, float]:
        return {n: s for n, (s, _) in self.table.items()}

    @functools.cached_property
    def plain(self) -> list[str | None]:
        """The text of each piece, None for those that are part of a character."""
        byte = lambda n: chr(int(n[3:5], 16)) if int(n[3:5], 16) < 128 else None
        texts = {BYTE: byte, UNKNOWN: lambda n: " \u2047 ", CONTROL: lambda n: ""}
        return [texts.get(k, lambda n: n.replace(MARK, " "))(n) for n, k in zip(self.names, self.kinds, strict=True)]

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @functools.cached_property
    def bytes(self) -> dict[int, int]:
        return {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}

    @functools.cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a Protocol Buffers message."""
    at = 0

    def number() -> int:
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
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> Pieces:
    """Pieces of a model file. Only models that leave characters and white space as they are can be read."""
    import struct

    names, scores, kinds, merges, prefix = [], [], [], False, True
    for field, value in _fields(data):
        if field == 1:
            part = dict(_fields(value))
            names.append(part[1].decode())
            scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            kinds.append(part.get(3, NORMAL))
        elif field == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
        elif field == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("the model normalizes characters or white space, which is not supported")
    return Pieces(tuple(names), tuple(scores), tuple(kinds), merges, prefix)


def load(path: str | None = None) -> Pieces:
    """The model at path, by default the one that the installed tokenizer files name piece_bpe_32k.model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return read_model(f.read())


def _fallback(char: str, pieces: Pieces) -> list[int]:
    return [pieces.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if pieces.bytes else [pieces.unknown]


def merges(word: str, pieces: Pieces) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """What merging leaves of a word, as spans, and the last merge's two parts as lengths. Of all neighbours whose union is a
    piece the best score merges first, the leftmost on a tie; n log n steps."""
    table, n, last = pieces.table, len(word), None
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[float, int, int]] = []

    def offer(i: int, j: int) -> None:
        hit = table.get(word[i : end[j]]) if end[j] - i <= pieces.longest else None
        if hit:
            heapq.heappush(queue, (-hit[0], i, end[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    alive = [True] * n
    while queue:
        _, i, to = heapq.heappop(queue)
        j = after[i]
        # Stale: one of the two has merged since.
        if not alive[i] or j >= n or end[j] != to or end[i] != j:
            continue
        last = (j - i, to - j)
        alive[j], end[i], after[i] = False, to, after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    spans, i = [], 0
    while i < n:
        spans.append((i, end[i]))
        i = end[i]
    return spans, last


def merged(word: str, pieces: Pieces) -> list[int]:
    """Ids of a word by merges."""
    ids: list[int] = []
    for i, j in merges(word, pieces)[0]:
        hit = pieces.table.get(word[i:j])
        ids += [hit[1]] if hit else _fallback(word[i], pieces)
    return ids


@dataclass
class Lattice:
    """The pieces as arrays: a trie in one array (the child of a node by a letter is the slot base[node] + letter, if
    check[slot] is the node), and of every piece its score, its rank among merges and the two parts it was merged from."""

    pieces: Pieces
    letter: np.ndarray  # of each code point; 0 for those in no piece
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of each slot, -1 for none
    score: np.ndarray
    rank: np.ndarray  # -1: a single letter
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray  # sorted (left << 32 | right) of all two pieces whose union is one, and the rank of that
    pair_rank: np.ndarray
    raw: np.ndarray  # bytes of all pieces, in order of id, for decoding, and where they start
    raw_at: np.ndarray
    marks: bool  # runs of two or more marks merge after all else, so that they can be split off

    def follow(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        slot = self.base[node] + letter
        return np.where((letter > 0) & (self.check[slot] == node), slot, -1)

    def union_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER) if len(self.pair) else np.full(len(x), NEVER)

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b together leaves these two: backwards in time, no two parts that
        met at their border could have merged before one of them went on into its next part (which, left of it, is first on a tie)."""
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        out, line = np.ones(len(a), bool), np.arange(len(a))
        while len(line):
            r, rx, ry = self.union_rank(x[line], y[line]), self.rank[x[line]], self.rank[y[line]]
            bad = (r < until_x[line]) & (r <= until_y[line])
            out[line[bad]] = False
            first = (rx > ry) & ~bad
            second = (ry >= rx) & (ry >= 0) & ~bad
            k = line[first]
            until_x[k], x[k] = rx[first], self.right[x[k]]
            k = line[second]
            until_y[k], y[k] = ry[second], self.left[y[k]]
            line = line[first | second]
        return out


def _trie(names: list[tuple[str, int]], letter: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    children: list[dict[int, int]] = [{}]
    ends = {}
    for name, piece in names:
        node = 0
        for c in name:
            node = children[node].setdefault(int(letter[ord(c)]), len(children))
            if node == len(children):
                children.append({})
        ends[node] = piece
    size = 1 << (4 * len(children) + 2 * codes).bit_length()
    free, rng = np.ones(size, bool), np.random.default_rng(3)
    free[0] = False
    place = np.zeros(len(children), np.int64)
    # Large nodes first; a random place fits soon, as a quarter of the slots at most are taken.
    for node in sorted(range(len(children)), key=lambda k: -len(children[k])):
        if children[node]:
            want = np.fromiter(children[node], np.int64)
            while True:
                tries = rng.integers(1, size - codes, 16)
                fits = np.flatnonzero(free[tries[:, None] + want].all(1))
                if len(fits):
                    place[node] = tries[fits[0]]
                    free[place[node] + want] = False
                    break
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    slot = np.zeros(len(children), np.int64)
    for node, below in enumerate(children):  # parents come before their children
        base[slot[node]] = place[node]
        for c, child in below.items():
            slot[child] = place[node] + c
            check[slot[child]] = slot[node]
    for node, p in ends.items():
        piece[slot[node]] = p
    return base, check, piece


@functools.lru_cache(4)
def lattice_of(pieces: Pieces) -> Lattice:
    """The arrays of a model, made once by the driver. Pieces that merging never leaves are no edges."""
    table = pieces.table
    names = sorted({c for n in table for c in n} | {MARK})
    letter = np.zeros(0x110000, np.int32)
    letter[[ord(c) for c in names]] = np.arange(1, len(names) + 1)
    n = len(pieces.names)
    rank, left, right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = {s: k for k, s in enumerate(sorted({s for s, _ in table.values()}, reverse=True))}
    pairs: dict[int, int] = {}
    edges, marks = [], True
    for name, (score, i) in table.items():
        whole = True
        if pieces.merges and len(name) > 1:
            spans, last = merges(name, pieces)
            whole = len(spans) == 1
            rank[i] = order[score]
            if whole:
                left[i], right[i] = table[name[: last[0]]][1] if last[0] > 1 or name[0] in table else 0, table[name[last[0] :]][1]
            for k in range(1, len(name)):
                if name[:k] in table and name[k:] in table:
                    pairs[table[name[:k]][1] << 32 | table[name[k:]][1]] = order[score]
        bare = name.lstrip(MARK)
        run = not bare and len(name) > 1
        # The rule of marks: inside a word none but at its start, and runs of marks have the worst score.
        marks &= run or (MARK not in bare and len(name) - len(bare) < 2)
        marks &= not run or score <= min((s for m, (s, _) in table.items() if m.strip(MARK)), default=0.0)
        if whole and not (pieces.merges and run):
            edges.append((name, i))
    raw = [_bytes_of(pieces, i) for i in range(n)]
    key = np.array(sorted(pairs), np.int64)
    return Lattice(
        pieces, letter, *_trie(edges, letter, len(names) + 1), np.array(pieces.scores), rank, left, right,
        key, np.array([pairs[k] for k in key.tolist()], np.int64),
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), bool(marks),
    )


def _bytes_of(pieces: Pieces, i: int) -> bytes:
    name, kind = pieces.names[i], pieces.kinds[i]
    if kind == BYTE:
        return bytes([int(name[3:5], 16)])
    return {UNKNOWN: " \u2047 ".encode(), CONTROL: b""}.get(kind, name.replace(MARK, " ").encode("utf-8", "surrogatepass"))


def edges_of(lattice: Lattice, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, length, piece) of words that follow one another: their substrings, joined by equality with the pieces.
    ends has the end of each letter's word. A letter in no piece is an edge with piece -1."""
    at, node, size = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
    starts, sizes, found = [], [], []
    while len(at):
        node = lattice.follow(node, letters[at + size])
        size += 1
        on = node >= 0
        at, node = at[on], node[on]
        piece = lattice.piece[node]
        hit = piece >= 0
        starts.append(at[hit])
        sizes.append(np.full(len(starts[-1]), size))
        found.append(piece[hit].astype(np.int64))
        if size == 1:
            alone = np.ones(len(letters), bool)
            alone[starts[0]] = False
            starts.append(np.flatnonzero(alone))
            sizes.append(np.ones(len(starts[-1]), np.int64))
            found.append(np.full(len(starts[-1]), -1))
        on = at + size < ends[at]
        at, node = at[on], node[on]
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(found)


class Encoder:
    """Encodes texts with a worker's bounded memory of words and of pairs of pieces; what comes later takes a slot."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.pieces = lattice, lattice.pieces
        self.pair_key, self.pair_stays = np.zeros(PAIR_SLOTS, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.word_key, self.word_size = np.zeros((WORD_SLOTS, 2), np.uint64), np.zeros(WORD_SLOTS, np.uint8)
        self.word_ids, self.word_count = np.zeros((WORD_SLOTS, WORD_IDS), np.int32), np.zeros(WORD_SLOTS, np.uint8)
        self.runs: dict[int, list[int]] = {}
        self.mark = self.pieces.table[MARK][1] if MARK in self.pieces.table else -2

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = ((a << 32) | b) + 1
        slot = (T.mix(key.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_stays[slot]
        if len(new):
            some, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            stays = self.lattice.stay(a[new[first]], b[new[first]])
            out[new] = stays[back]
            s = slot[new[first]]
            self.pair_key[s], self.pair_stays[s] = some, stays
            # Two keys of one slot: the last one written counts for both arrays.
            self.pair_stays[s] = np.where(self.pair_key[s] == some, stays, self.pair_stays[s])
            lost = s[self.pair_key[s] != some]
            self.pair_key[lost] = 0
        return out

    def fold(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, their starts, pieces of each word) of words given by their letters and starts (one more than words)."""
        length = np.diff(starts)
        word = np.repeat(np.arange(len(length)), length)
        begin, size, piece = edges_of(self.lattice, letters, starts[1:][word])
        owner = word[begin]
        # Places: a word of n letters has n + 1.
        start, end, step = begin + owner, begin + owner + size, begin - starts[owner] + size
        order = np.argsort(step.astype(np.uint16), kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        cut = np.searchsorted(step, np.arange(1, int(length.max(initial=0)) + 2))
        places = len(letters) + len(length)
        kept, back = np.full(places, -3), np.zeros(places, np.int64)
        kept[starts[:-1] + np.arange(len(length))] = -2
        best = np.where(kept == -2, 0.0, -np.inf)
        worst = float(self.lattice.score.min()) - 10
        for j in range(len(cut) - 1):
            part = slice(cut[j], cut[j + 1])
            s, e, p = start[part], end[part], piece[part]
            if self.pieces.merges:
                before = kept[s]
                ok = (before == -2) | (before == -1) | ((p == -1) & (before >= 0))
                ask = np.flatnonzero((before >= 0) & (p >= 0))
                ok[ask] = self.stay(before[ask], p[ask])
            else:
                total = best[s] + np.where(p >= 0, self.lattice.score[p], worst)
                # By end, then sum, then the longest edge: the first of each end is kept.
                rank = np.lexsort((s, -total, e))
                ok = np.zeros(len(s), bool)
                ok[rank[np.concatenate([[True], e[rank][1:] != e[rank][:-1]])] if len(s) else rank] = True
                best[e[ok]] = total[ok]
            kept[e[ok]], back[e[ok]] = p[ok], s[ok]
        last = starts[1:] + np.arange(len(length))
        if (kept[last] == -3).any():
            raise AssertionError("a word without a path")
        on = np.zeros(places, bool)
        at = last[length > 0]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[kept[at] != -2]
        place = np.flatnonzero(on)
        owner = np.searchsorted(last, place)
        return kept[place], back[place] - owner, np.bincount(owner, minlength=len(length))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each word) of words without an inner mark."""
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and len(texts[to]) <= LONG and (to == at or total < CHUNK):
                total += len(texts[to])
                to += 1
            if to == at:  # a long word
                ids = np.array(merged(texts[at], self.pieces) if self.pieces.merges else best_path(texts[at], self.pieces), np.int64)
                counts[at] = len(ids)
                parts.append(ids)
                at += 1
                continue
            points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])])
            piece, begin, count = self.fold(self.lattice.letter[points].astype(np.int64), starts)
            if (lone := np.flatnonzero(piece < 0)).size:
                spare = [_fallback(chr(c), self.pieces) for c in points[begin[lone]].tolist()]
                times = np.ones(len(piece), np.int64)
                times[lone] = [len(x) for x in spare]
                count = np.add.reduceat(np.append(times, 0), np.minimum(np.cumsum(count) - count, len(times))) * (count > 0)
                piece = np.repeat(piece, times)
                piece[piece < 0] = [i for x in spare for i in x]
            counts[at:to] = count
            parts.append(piece)
            at = to
        return np.concatenate([np.zeros(0, np.int64), *parts]), counts

    def run(self, marks: int) -> list[int]:
        """Ids of a run of marks."""
        got = self.runs.get(marks)
        if got is None:
            got = merged(MARK * marks, self.pieces)
            if marks <= 256:
                self.runs[marks] = got
        return got

    def remembered(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of the words of a buffer of bytes; marked ones have a mark before them."""
        wide = np.concatenate([buffer, np.zeros(WORD_BYTES, np.uint8)])
        eight = np.zeros(len(wide) - 7, np.uint64)
        for k in range(8):
            eight |= wide[k : k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        tag = (np.minimum(sizes, WORD_BYTES) + 32 * marked + 64).astype(np.uint8)
        one, two = eight[starts] & mask[np.minimum(sizes, 8)], eight[starts + 8] & mask[np.clip(sizes - 8, 0, 8)]
        slot = (T.mix(one ^ T.mix(two + tag)) & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
        short = sizes <= WORD_BYTES
        known = short & (self.word_size[slot] == tag) & (self.word_key[slot, 0] == one) & (self.word_key[slot, 1] == two)
        counts = np.where(known, self.word_count[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        raw = buffer.tobytes()
        every = [(MARK if m else "") + raw[a : a + n].decode("utf-8", "replace") for a, n, m in zip(starts[new].tolist(), sizes[new].tolist(), marked[new].tolist(), strict=True)]
        index = dict.fromkeys(every)
        distinct = list(index)
        index = {t: i for i, t in enumerate(distinct)}
        fresh, fresh_count = self.words(distinct)
        back = np.fromiter((index[t] for t in every), np.int64, len(every))
        fresh_at = np.cumsum(fresh_count) - fresh_count
        counts[new] = fresh_count[back]
        out_at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        old = np.flatnonzero(known)
        inside = ragged(counts[old])
        ids[np.repeat(out_at[old], counts[old]) + inside] = self.word_ids[np.repeat(slot[old], counts[old]), inside]
        inside = ragged(counts[new])
        ids[np.repeat(out_at[new], counts[new]) + inside] = fresh[np.repeat(fresh_at[back], counts[new]) + inside]
        # One word of a slot is kept whole: the last.
        keep = new[short[new] & (counts[new] <= WORD_IDS)]
        _, first = np.unique(slot[keep][::-1], return_index=True)
        keep = keep[len(keep) - 1 - first]
        s, n = slot[keep], counts[keep]
        self.word_size[s], self.word_key[s, 0], self.word_key[s, 1], self.word_count[s] = tag[keep], one[keep], two[keep], n
        inside = ragged(n)
        self.word_ids[np.repeat(s, n), inside] = ids[np.repeat(out_at[keep], n) + inside]
        return ids, counts

    def encode(self, segments: list[bytes], prefix: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each segment): bytes of UTF-8 that begin a text or follow a space-free end."""
        whole = [(b" " if p and s else b"") + s for s, p in zip(segments, prefix, strict=True)]
        buffer = np.frombuffer(b"".join(whole), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in whole])])
        if not (self.lattice.marks and self.pieces.merges):
            return self._plain(whole)
        inside = buffer != 32
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        over = inside.copy()
        over[:-1] &= ~inside[1:]
        new[edge[:-1][edge[:-1] < len(buffer)]] |= inside[edge[:-1][edge[:-1] < len(buffer)]]
        some = edge[1:][edge[1:] > 0] - 1
        over[some] |= inside[some]
        start, end = np.flatnonzero(new), np.flatnonzero(over) + 1
        # An empty word at the end of each segment takes the spaces that no word follows.
        start, end = np.concatenate([start, edge[1:]]), np.concatenate([end, edge[1:]])
        real = np.arange(len(start)) < len(start) - len(segments)
        order = np.argsort(2 * start + real, kind="stable")
        start, end, real = start[order], end[order], real[order]
        owner = np.zeros(len(start), np.int64)
        owner[1:] = np.cumsum(~real)[:-1]
        before = np.maximum(np.concatenate([[0], end[:-1]]), edge[:-1][owner] if len(segments) else 0)
        spaces = start - before
        at = np.flatnonzero(real)
        ids, counts = self.remembered(buffer, start[at], (end - start)[at], spaces[at] > 0)
        count = np.zeros(len(start), np.int64)
        count[at] = counts
        first = np.cumsum(count) - count
        # More than one space: a run of marks by itself, with the word's own mark if that stays alone.
        many = np.flatnonzero((spaces > 1) | (~real & (spaces > 0)))
        alone = np.zeros(len(many), bool)
        mine = real[many]
        alone[mine] = ids[first[many[mine]]] == self.mark
        run = np.where(mine, spaces[many] - 1 + alone, spaces[many])
        drop = np.zeros(len(start), np.int64)
        drop[many] = alone
        runs = [self.run(int(m)) for m in run]
        extra = np.zeros(len(start), np.int64)
        extra[many] = [len(r) for r in runs]
        total = extra + count - drop
        place = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.int32)
        n = count - drop
        inner = ragged(n)
        out[np.repeat(place + extra, n) + inner] = ids[np.repeat(first + drop, n) + inner]
        if len(many):
            out[np.repeat(place[many], extra[many]) + ragged(extra[many])] = np.concatenate([np.array(r, np.int32) for r in runs])
        return out, np.bincount(owner, weights=total, minlength=len(segments)).astype(np.int64)

    def _plain(self, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Models of scores, or with marks inside pieces: every word with all marks before it."""
        texts = [w.decode("utf-8", "replace").replace(" ", MARK) for w in whole]
        units = [_units(t) for t in texts]
        if self.pieces.merges:
            got = [np.array(merged(u, self.pieces), np.int64) for unit in units for u in unit]
            ids, counts = np.concatenate([np.zeros(0, np.int64), *got]), np.array([len(x) for x in got], np.int64)
        else:
            ids, counts = self.words([u for unit in units for u in unit])
        owner = np.repeat(np.arange(len(whole)), [len(u) for u in units])
        return ids.astype(np.int32), np.bincount(owner, weights=counts, minlength=len(whole)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of all pieces."""
        start = self.lattice.raw_at[ids]
        size = self.lattice.raw_at[ids + 1] - start
        return self.lattice.raw[np.repeat(start, size) + ragged(size)].tobytes()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 of each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _units(text: str) -> list[str]:
    """The words of a text: each with the marks before it; no piece goes beyond one."""
    out, at = [], 0
    while at < len(text):
        to = at
        while to < len(text) and text[to] == MARK:
            to += 1
        cut = text.find(MARK, to)
        out.append(text[at : (cut if cut >= 0 else len(text)) if to < len(text) else to])
        at += len(out[-1])
    return out


def best_path(word: str, pieces: Pieces) -> list[int]:
    """Ids of a word by the best sum of scores; a character without a piece costs 10 below the least score."""
    table, n, worst = pieces.table, len(word), min(pieces.scores) - 10
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
    for j in range(1, n + 1):
        options = []
        for i in range(max(0, j - pieces.longest), j):
            hit = table.get(word[i:j])
            if hit or i == j - 1:
                score, piece = hit or (worst, -1)
                options.append((best[i][0] + score, -i, piece))
        best.append(max(options))
    ids: list[int] = []
    j = n
    while j:
        _, i, piece = best[j]
        ids[:0] = [piece] if piece >= 0 else _fallback(word[-i:j], pieces)
        j = -i
    return ids


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts that begin with the first of some spaces."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        to = text.find(b" ", at + CHUNK)
        while to > 0 and text[to - 1] == 32:
            to = text.find(b" ", to + 1)
        if to <= at:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """Text of ids: bytes are joined to characters, marks are spaces, and the first of them is the dummy prefix."""
    plain = pieces.plain
    parts = [plain[i] for i in ids]
    if None in parts:
        raw = [bytes([int(pieces.names[i][3:5], 16)]) if p is None else p.encode() for i, p in zip(ids, parts, strict=True)]
        text = b"".join(raw).decode("utf-8", "replace")
    else:
        text = "".join(parts)
    return text[1:] if pieces.dummy_prefix and text.startswith(" ") else text


def encode_texts(texts: list[bytes | None], encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, ids of each text); those of null texts are none."""
    owner, parts, prefix = [], [], []
    for i, text in enumerate(texts):
        for k, part in enumerate(_segments((text or b"").replace(MARK.encode(), b" "))):
            owner.append(i)
            parts.append(part)
            prefix.append(encoder.pieces.dummy_prefix and k == 0)
    counts, out, at = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= CHUNK):
            size += len(parts[to])
            to += 1
        ids, n = encoder.encode(parts[at:to], prefix[at:to])
        np.add.at(counts, owner[at:to], n)
        out.append(ids)
        at = to
    return np.concatenate(out), counts


def _encoded(shared, check: bool) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                # About CHUNK bytes at a time: ids are several times as large as their text.
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (not texts or size < CHUNK):
                    texts.append(column[at + len(texts)].as_py())
                    size += len(texts[-1] or b"")
                ids, counts = encode_texts(texts, encoder)
                edge = np.concatenate([[0], np.cumsum(counts)])
                nulls = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32(), mask=np.append(nulls, False)), pa.array(ids))
                columns = [batch.column("doc_id").slice(at, len(texts)), lists]
                if check:
                    same = [None if t is None else _same(encoder, ids[a:b], t) for t, a, b in zip(texts, edge, edge[1:], strict=False)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "round_trip"][: len(columns)])
                at += len(texts)

    return step


def _same(encoder: Encoder, ids: np.ndarray, text: bytes) -> bool:
    """Whether ids decode to the text, but that its marks are spaces."""
    got = encoder.decode(ids)
    return got[1 if encoder.pieces.dummy_prefix and got[:1] == b" " else 0 :] == text.replace(MARK.encode(), b" ")


def _decoded(shared) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        for batch in batches:
            texts = [None if x is None else decode_ids(x, pieces) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return step


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, as the model's own library encodes the whole text.

    A null text has null ids, an empty one has none. Characters without a piece become their bytes' pieces, or
    the unknown piece. check adds round_trip: decoding gives the text again, but that its marks U+2581
    are spaces (null for a null text). Null ids and repeated rows keep their places, other columns are not
    read, and empty tables give no rows. Of two paths with one sum of scores, the longer last piece wins.

    No shuffle. A worker holds a part of CHUNK bytes of text with its lattice at a time, however long the
    text, and remembers words and pairs in arrays of fixed size.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, ids array<int>" + ", round_trip boolean" * check
    return rows.mapInArrow(_encoded(docs.sparkSession.sparkContext.broadcast(lattice_of(pieces)), check), schema)


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: doc_id, text. The inverse of encode for models with byte pieces, but
    that the mark U+2581 in a text comes back as a space."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoded(encoded.sparkSession.sparkContext.broadcast(pieces)), "doc_id long, text string")
