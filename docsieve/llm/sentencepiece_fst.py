"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file of BPE type is compiled once, on the driver, into arrays:

* the *normaliser* rewrites space as U+2581 and begins a text with one (the
  model's flags; only the identity character map is accepted);
* the *piece automaton* is a trie of states whose transitions are labelled with
  characters; where a state ends a piece, an arc writes that piece for weight 1;
* *byte fallback* arcs read a character that is no piece and write its UTF-8
  bytes, for weight 1 a byte (a character that pieces hold stays a symbol at borders);
* the *boundary automaton* has the piece read last as its state. Going on to
  another piece is free where BPE of the two pieces' text is just these two, and
  costs ``VIOLATION`` where it merges across their border. Whether it does follows
  from how both pieces are merged: the derivations and all merges are compiled,
  pairs are looked up as composition meets them.

A sequence is the BPE of its text if and only if every neighbouring pair is, so
the path of least weight in the composition of a text with the machine is the
BPE, although merges are no weights of single pieces. Beginnings of a text have
one BPE each, so a position keeps one path, the least to it (tropical semiring:
weights add along a path, the least path counts), and its last arc. Composition
is over stretches: no piece crosses from one into the next, as none holds the two
characters at the border side by side. Many distinct stretches are composed at
once, position by position; met stretches are kept, found by a 64-bit code and
compared character by character.

Null is the empty text: no pieces, and decodes to the empty text. Repeated rows
are encoded one by one. Memory follows the longest text, and the longest stretch
of it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import run_codes

SPACE = "\u2581"
#: Stretches whose ids a worker keeps, and their characters; both may be passed by those of one slab.
CACHED, CACHED_CHARS = 400_000, 1 << 23
#: Characters of texts that are looked up at once, and of new stretches that are composed at once.
SLAB, BLOCK = 1 << 18, 1 << 16
#: Positions with fewer arcs go arc by arc if there are many such positions; pairs of arcs looked up at once for them.
FEW, MANY, PAIRS = 64, 256, 1 << 18
VIOLATION = 1 << 32
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean"


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Transducer:
    """The compiled machine of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer, normaliser = (dict(fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        if trainer.get(3, 1) != BPE or normaliser.get(2):
            raise ValueError("only BPE models with the identity character map are compiled")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        if normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models that keep and mark all spaces are compiled")
        self.byte_ids = np.zeros(256, np.int64)
        self.written: list[bytes] = []
        ids: dict[str, int] = {}
        score: dict[str, float] = {}
        for i, raw in enumerate(v for k, v in model if k == 1):
            own = dict(fields(raw))
            piece, kind = own.get(1, b"").decode(), own.get(3, NORMAL)
            self.written.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.encode())
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.written[i] = bytes([int(piece[1:-1], 16)])
            elif kind == NORMAL:
                ids[piece] = i
                score[piece] = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
        self.is_byte = np.zeros(len(self.written), bool)
        self.is_byte[self.byte_ids] = True
        self.n_written = np.array([len(x) for x in self.written])
        self.written_at = np.cumsum(self.n_written) - self.n_written
        self.all_written = np.frombuffer(b"".join(self.written), np.uint8)
        symbols = self._compile_merges(ids, score)
        self._compile_trie({p: i for p, i in symbols.items() if i in self.reachable or i >= len(self.written)})
        inside = np.array(sorted({(ord(a), ord(b)) for p in ids for a, b in zip(p, p[1:], strict=False)}), np.uint32).reshape(-1, 2)
        self.joined = np.zeros(1 << 20, bool)
        self.joined[_pair_place(inside[:, 0], inside[:, 1])] = True
        self.kept = Kept()
        self.known_pairs = np.zeros(1 << 20, np.int64)
        self.known_fit = np.ones(1 << 20, bool)

    def _compile_merges(self, ids: dict[str, int], score: dict[str, float]) -> dict[str, int]:
        """How each piece is merged (its last two parts and when), and when two symbols are merged.

        Symbols are the pieces, and the characters that are only parts of some: these are numbered after all pieces.
        """
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p}):
            symbols.setdefault(c, len(self.written) + len(symbols) - len(ids))
        rank = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        order = {p: rank[x] for p, x in score.items()}
        n = len(self.written) + len(symbols) - len(ids)
        self.when = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.reachable: set[int] = set()
        when: dict[str, int] = {}

        def time(a: str, b: str) -> int:
            """When two symbols become one: in the order of scores, but not before both stand there; among those at once, by score."""
            own = order[a + b]
            return max(own << 20, when.get(a, 0) >> 20 << 20, when.get(b, 0) >> 20 << 20) | own

        for piece, i in sorted(ids.items(), key=lambda x: len(x[0])):
            parts = last = list(piece)
            while len(parts) > 1 and (merged := merged_once(parts, score)) is not parts:
                last, parts = parts, merged
            if len(parts) == 1:
                self.reachable.add(i)
                if len(piece) > 1:
                    when[piece] = time(*last)
                    self.when[i], self.left[i], self.right[i] = when[piece], symbols[last[0]], symbols[last[1]]
        found = {}
        for piece in ids:
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = time(piece[:k], piece[k:])
        self.merge_keys = np.array(sorted(found), np.int64)
        self.merge_when = np.array([found[k] for k in self.merge_keys.tolist()], np.int64)
        return symbols

    def _compile_trie(self, ids: dict[str, int]) -> None:
        """States and transitions of the piece automaton; state 0 is its beginning."""
        step: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for piece, i in ids.items():
            state = 0
            for c in piece:
                state = step.setdefault((state, ord(c)), len(step) + 1)
            ends[state] = i
        keys = sorted(step)
        self.arc_keys = np.array([s << 21 | c for s, c in keys], np.int64)
        self.arc_to = np.array([step[k] for k in keys], np.int64)
        self.accepts = np.full(len(step) + 1, -1, np.int64)
        self.accepts[list(ends)] = list(ends.values())

    def go(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, -1 for none."""
        return _found(self.arc_keys, self.arc_to, state << 21 | char, -1)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces ``a`` and ``b`` side by side.

        Both derivations are undone from the last merge backwards. What stands at
        the border is then what stood there while BPE ran; if it can be merged
        before its own next merge (the left one first among equals), it would be.
        """
        out = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER, np.int64), np.full(len(a), NEVER, np.int64)
        at = np.arange(len(a))
        while len(at):
            when = _found(self.merge_keys, self.merge_when, x << 32 | y, NEVER)
            across = (when < until_x) & (when <= until_y)
            out[at[across]] = False
            open_ = ~across & ((self.when[x] >= 0) | (self.when[y] >= 0))
            at, x, y, until_x, until_y = at[open_], x[open_], y[open_], until_x[open_], until_y[open_]
            undo = self.when[x] > self.when[y]
            until_x, until_y = np.where(undo, self.when[x], until_x), np.where(undo, until_y, self.when[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def boundary(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The weight of going on from piece ``a`` to piece ``b``, -1 standing for bytes; recent pairs are kept."""
        key = (a + 1) << 32 | (b + 1)
        out = np.zeros(len(key), np.int64)
        place = ((key * 0x9E3779B97F4A7C1) >> 40) & (len(self.known_pairs) - 1)
        new = (self.known_pairs[place] != key) & (a >= 0) & (b >= 0)
        if new.any():
            pairs, inverse = np.unique(key[new], return_inverse=True)
            fit = self.fits((pairs >> 32) - 1, (pairs & 0xFFFFFFFF) - 1)
            out[new] = np.where(fit, 0, VIOLATION)[inverse]
        old = ~new & (a >= 0) & (b >= 0)
        out[old] = np.where(self.known_fit[place[old]], 0, VIOLATION)
        if new.any():
            # of several pairs for one place, both arrays take the last
            put, last = np.unique(place[new][::-1], return_index=True)
            self.known_pairs[put], self.known_fit[put] = key[new][::-1][last], out[new][::-1][last] == 0
        return out

    def arcs(self, char: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all arcs over ``char``, sorted by start; ``end`` is where each position's stretch ends."""
        at, state = np.arange(len(char)), np.zeros(len(char), np.int64)
        starts, lengths, pieces = [], [], []
        length = 0
        while len(at):
            inside = at + length < end[at]
            at, state = at[inside], state[inside]
            state = self.go(state, char[at + length])
            there = state >= 0
            if not length:
                lone = at[~there | (self.accepts[state] < 0)]
                starts.append(lone)
                lengths.append(np.ones(len(lone), np.int64))
                pieces.append(np.full(len(lone), -1))
            at, state = at[there], state[there]
            length += 1
            whole = self.accepts[state] >= 0
            starts.append(at[whole])
            lengths.append(np.full(np.count_nonzero(whole), length))
            pieces.append(self.accepts[state[whole]])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        return start[order], np.concatenate(lengths)[order], np.concatenate(pieces)[order]

    def shortest_paths(self, char: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of ``size`` characters each, one after the other, along the paths of least weight, and how many each has."""
        upto = np.cumsum(size)
        start, length, piece = self.arcs(char, np.repeat(upto, size))
        whole = (piece >= 0) & (piece < len(self.written))
        weight = np.where(whole, 1, _utf8_length(char[start]))
        # a stretch has a state before each character and one at its end
        number = np.repeat(np.arange(len(size)), size)[start]
        source = start + number
        target = source + length
        total = np.zeros(len(char) + len(size), np.int64)
        last = np.full(len(total), -1)  # the piece read last, -1 for the bytes of a character in no piece and at the beginning
        came = np.full(len(total), -1)  # the arc read last
        place = start + length - (upto - size)[number]
        order = np.argsort(place << 32 | target)
        levels = np.flatnonzero(np.diff(place[order], prepend=0, append=place[order[-1]] + 1))
        wide = np.flatnonzero(np.diff(levels) >= FEW)
        wide = len(levels) - 1 if len(levels) < MANY else wide[-1] + 1 if len(wide) else 0
        for lo, hi in zip(levels[:wide].tolist(), levels[1 : wide + 1].tolist(), strict=True):
            own = order[lo:hi]
            begin, to = source[own], target[own]
            way = total[begin] + weight[own] + self.boundary(last[begin], piece[own])
            groups = np.flatnonzero(np.diff(to, prepend=-1))
            least = np.minimum.reduceat(way, groups)
            hit = np.flatnonzero(way == np.repeat(least, np.diff(groups, append=hi - lo)))
            best = own[hit[np.searchsorted(hit, groups)]]
            to = to[groups]
            total[to], last[to], came[to] = least, piece[best], best
        if wide < len(levels) - 1:
            came = self._arc_by_arc(order[levels[wide] :], source, target, weight, piece, total, came)
        path = []
        now = came[upto + np.arange(len(size))]
        while len(now):
            path.append(now)
            now = came[source[now]]
            now = now[now >= 0]
        arc = np.sort(np.concatenate(path))  # arcs are in order of their start
        whole, n_ids = whole[arc], weight[arc]
        after = np.cumsum(n_ids)
        ids = np.zeros(after[-1], np.uint32)
        ids[after[whole] - 1] = piece[arc[whole]]
        for k in np.flatnonzero(~whole):
            ids[after[k] - n_ids[k] : after[k]] = self.byte_ids[list(chr(char[start[arc[k]]]).encode())]
        return ids, np.diff(after[np.searchsorted(start[arc], upto) - 1], prepend=0)

    def _arc_by_arc(self, arcs: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, piece: np.ndarray, total: np.ndarray, came: np.ndarray) -> np.ndarray:
        """``came`` as shortest_paths goes on to set it, along ``arcs``: weights of all pairs that may come up are looked up ahead."""
        by_end = np.argsort(target, kind="stable")
        ends = target[by_end]
        rank = np.empty(len(by_end), np.int64)  # among the arcs with the same end
        rank[by_end] = np.arange(len(by_end)) - np.searchsorted(ends, ends)
        before = np.searchsorted(ends, source[arcs])
        n_before = np.searchsorted(ends, source[arcs], "right") - before
        upto = np.cumsum(n_before)
        total, came, rank = total.tolist(), came.tolist(), rank.tolist()
        lo = 0
        while lo < len(arcs):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            own, n = arcs[lo:hi], n_before[lo:hi]
            pairs = self.boundary(piece[by_end[_runs(before[lo:hi], n)]], np.repeat(piece[own], n)).tolist()
            first = (upto[lo:hi] - n - done).tolist()
            for arc, a, b, w, k in zip(own.tolist(), source[own].tolist(), target[own].tolist(), weight[own].tolist(), first, strict=True):
                way = total[a] + w + (pairs[k + rank[came[a]]] if came[a] >= 0 else 0)
                if came[b] < 0 or way < total[b]:
                    total[b], came[b] = way, arc
            lo = hi
        return np.array(came)

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def stretches(self, char: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Where stretches begin in texts that end at ``upto``: at a text's beginning, and between characters that no piece holds side by side."""
        begins = np.ones(len(char), bool)
        begins[1:] = ~self.joined[_pair_place(char[:-1], char[1:])]
        begins[upto[upto < len(char)]] = True
        return np.flatnonzero(begins)

    def new_entries(self, char: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Composes stretches of ``char`` and keeps their ids; their numbers."""
        out = [np.zeros(0, np.int64)]
        upto = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, "right")))
            own = char[_runs(begin[lo:hi], size[lo:hi])]
            out.append(self.kept.add(own, size[lo:hi], *self.shortest_paths(own.astype(np.int64), size[lo:hi])))
            lo = hi
        return np.concatenate(out)

    def look_up(self, char: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of ``size`` characters each, one after the other, and how many each has."""
        kept = self.kept
        if len(kept.size) > CACHED or len(kept.char) > CACHED_CHARS:
            kept = self.kept = Kept()
        begin = np.cumsum(size) - size
        code = run_codes(char.view(np.uint8), 4 * begin, 4 * (begin + size))
        entry = kept.find(code)
        new = np.flatnonzero(entry < 0)
        if len(new):
            codes, one, inverse = np.unique(code[new], return_index=True, return_inverse=True)
            own = self.new_entries(char, begin[new[one]], size[new[one]])
            kept.place(codes, own)
            entry[new] = own[inverse]
        # stretches that share a code with another one are composed on their own
        other = kept.size[entry] != size
        differs = kept.char.take(_runs(kept.char_at[entry], size), mode="clip") != char
        other[np.searchsorted(begin, np.flatnonzero(differs), "right") - 1] = True
        if other.any():
            entry[other] = self.new_entries(char, begin[other], size[other])
        n_ids = kept.n_ids[entry]
        return kept.ids[_runs(kept.ids_at[entry], n_ids)], n_ids

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other; those of text ``i`` are from place ``i`` of the second array to the next."""
        normal = [self.normalise(x) for x in texts]
        char = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint32)
        upto = np.cumsum([0, *map(len, normal)])
        if not len(char):
            return np.zeros(0, np.uint32), upto
        begin = self.stretches(char, upto)
        size = np.diff(begin, append=len(char))
        found = []
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SLAB)))
            found.append(self.look_up(char[begin[lo] : begin[hi - 1] + size[hi - 1]], size[lo:hi]))
            lo = hi
        ids, n_ids = map(np.concatenate, zip(*found, strict=True))
        return ids, np.concatenate([[0], np.cumsum(n_ids)])[np.searchsorted(begin, upto)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        ids, at = self.encode_flat(texts)
        raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: the machine read backwards."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def decodes(self, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether each text's ids, as ``encode_flat`` gives them, decode to it; those that write the normalised text do."""
        slabs = [ids[lo : lo + SLAB] for lo in range(0, len(ids), SLAB)]
        raw = b"".join([self.all_written[_runs(self.written_at[x], self.n_written[x])].tobytes() for x in slabs])
        ends = np.concatenate([[0], np.cumsum(self.n_written[ids])])[at].tolist()
        return [
            raw[ends[i] : ends[i + 1]] == self.normalise(x).encode() or self.decode(ids[at[i] : at[i + 1]].tolist()) == x.replace(SPACE, " ")
            for i, x in enumerate(texts)
        ]


class Kept:
    """Stretches met, and their ids: entries are numbered, a code leads to one of them or, where places are taken, to none."""

    def __init__(self):
        self.slots = np.full(1 << 20, -1, np.int32)
        self.rows: dict[str, tuple[np.ndarray, int]] = {
            name: (np.zeros(1024, kind), 0)
            for name, kind in (("char", np.uint32), ("ids", np.uint32), ("code", np.uint64), ("size", np.int64), ("n_ids", np.int64), ("char_at", np.int64), ("ids_at", np.int64))
        }

    def __getattr__(self, name: str) -> np.ndarray:
        if name == "rows" or name not in self.rows:
            raise AttributeError(name)
        room, n = self.rows[name]
        return room[:n]

    def append(self, **columns: np.ndarray) -> None:
        for name, own in columns.items():
            room, n = self.rows[name]
            if n + len(own) > len(room):
                room = np.concatenate([room[:n], np.zeros(max(n, len(own)), room.dtype)])
            room[n : n + len(own)] = own
            self.rows[name] = room, n + len(own)

    def add(self, char: np.ndarray, size: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """Numbers of new entries, whose characters and ids stand one after the other; no code leads to them yet."""
        first = len(self.size)
        self.append(size=size, n_ids=n_ids, char_at=len(self.char) + np.cumsum(size) - size, ids_at=len(self.ids) + np.cumsum(n_ids) - n_ids)
        self.append(char=char, ids=ids, code=np.zeros(len(size), np.uint64))
        return first + np.arange(len(size))

    def _places(self, code: np.ndarray) -> Iterator[np.ndarray]:
        for shift in (44, 24):
            yield (code >> np.uint64(shift)).astype(np.int64) & (len(self.slots) - 1)

    def place(self, code: np.ndarray, entry: np.ndarray) -> None:
        """Codes lead to entries from now on: from their first place if it is free, else from their second, whatever stood there."""
        self.code[entry] = code
        first, second = self._places(code)
        free = self.slots[first] < 0
        self.slots[first[free]] = entry[free]
        rest = self.slots[first] != entry
        self.slots[second[rest]] = entry[rest]

    def find(self, code: np.ndarray) -> np.ndarray:
        """The entry of each code, -1 for none."""
        out = np.full(len(code), -1)
        if len(self.code):
            for place in self._places(code):
                entry = self.slots[place]
                hit = (out < 0) & (entry >= 0) & (self.code[entry] == code)
                out[hit] = entry[hit]
        return out


def merged_once(parts: list[str], score: dict[str, float]) -> list[str]:
    """BPE by its definition, one step: the best-scored neighbours, leftmost first, become one; the same list if none are a piece."""
    pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
    if not pairs:
        return parts
    i = min(pairs)[1]
    return [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: int) -> np.ndarray:
    """The values of the ``wanted`` keys, ``other`` where there is none."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], other)


def _pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a table of 2^20 places holds a pair of characters; some pairs share a place."""
    return ((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA6B)) >> np.uint32(12)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first[i]`` to ``first[i] + size[i]``, one run after the other."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def _utf8_length(char: np.ndarray) -> np.ndarray:
    return 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)


#: Rows, and bytes of whole texts, that are encoded at once.
PORTION, PORTION_BYTES = 256, 1 << 21


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    upto = np.cumsum([0, *pc.binary_length(batch.column(1)).fill_null(0).to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + PORTION, max(lo + 1, int(np.searchsorted(upto, upto[lo] + PORTION_BYTES, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def sentencepiece(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _portions(batch):
                ids, at_id = compiled.value.encode_flat([x or "" for x in some.column(1).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(at_id, pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    return _texts(docs, text, doc_id).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digest of the ids of every row of ``docs``, and whether they decode to the text (U+2581 in a text comes back as space)."""
    compiled = docs.sparkSession.sparkContext.broadcast(Transducer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled.value
        for batch in batches:
            for some in _portions(batch):
                texts = [x or "" for x in some.column(1).to_pylist()]
                ids, first = machine.encode_flat(texts)
                raw = memoryview(ids.astype("<u4").tobytes())
                bytes_upto = np.concatenate([[0], np.cumsum(machine.is_byte[ids])])
                columns = [
                    some.column(0),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(np.diff(bytes_upto[first]), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.int64()),
                    pa.array(machine.decodes(ids, first, texts), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return _texts(docs, text, doc_id).mapInArrow(run, SCHEMA)
