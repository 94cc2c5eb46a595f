"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads the text once; at each position its output
links give the pieces that end there, longest first, and a dynamic programme
keeps the last piece of the best segmentation of the text so far.  For unigram
models best means the highest sum of scores.  For BPE models the best
segmentation is the one that merging by score gives; it is the only one whose
neighbours all stand apart under merging, so a piece is accepted if the pair
with the piece before it does.  (Sums of BPE scores, which are ranks, would
prefer many short pieces.)

No piece holds a blank after another character or a line end, so texts are cut
there and each distinct segment of a batch is encoded once, all segments of a
batch in step, with array operations.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column, text_slices
from .wordscan import _hash_spans, mix, text_bytes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_B = np.uint64(0x100000001B3)
_NONE, _UNKNOWN = -1, -2
_MEMO = 1 << 20


class Table:
    """Hash table from 64-bit keys to numbers, probed by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, dtype=np.uint64)
        self.values = np.full(self.mask + 1, -1, dtype=np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] < 0
            cand = todo[free]
            _, first = np.unique(at[cand], return_index=True)
            won = cand[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + (self.values[at[todo]] >= 0)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if there is none."""
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out


@dataclass
class Vocabulary:
    """Pieces with the blank for the word mark, their scores and kinds."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    bpe: bool

    @classmethod
    def load(cls, model: bytes) -> "Vocabulary":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto.FromString(model)
        n = sp.get_piece_size()
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        names = [sp.id_to_piece(i) for i in range(n)]
        of_byte = np.full(256, sp.unk_id(), dtype=np.int64)
        pieces = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                of_byte[int(name[1:-1], 16)] = i
                pieces.append(bytes([int(name[1:-1], 16)]))
            else:
                pieces.append(b"" if sp.is_control(i) or sp.is_unknown(i) else name.replace("▁", " ").encode())
        return cls(pieces, np.array([sp.get_score(i) for i in range(n)]), np.array([not odd(i) for i in range(n)]), of_byte, spec.trainer_spec.model_type == 2)


def merge(text: str, rank: dict[str, float]) -> list[str]:
    """BPE by merging: the adjacent pair whose union ranks first, leftmost of equals, until none is a piece."""
    s, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] < len(s) and (r := rank.get(s[i] + s[nxt[i]])) is not None:
            heapq.heappush(heap, (r, i, s[i], s[nxt[i]]))

    for i in range(len(s)):
        offer(i)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = nxt[i]
        if s[i] != x or j >= len(s) or s[j] != y or not x:
            continue
        s[i], s[j], nxt[i] = x + y, "", nxt[j]
        if nxt[j] < len(s):
            prv[nxt[j]] = i
        offer(prv[i])
        offer(i)
    return [x for x in s if x]


class Encoder:
    """Automaton and tables of a vocabulary; plain arrays, so that it travels to the tasks."""

    def __init__(self, v: Vocabulary):
        self.v = v
        use = [i for i in range(len(v.pieces)) if v.normal[i] and v.pieces[i]]
        text = {i: v.pieces[i].decode() for i in use}
        self.known_chars = {t for t in text.values() if len(t) == 1}
        self.rank = {text[i]: -v.scores[i] for i in use if len(text[i]) > 1}
        n = len(v.pieces)
        order = sorted((i for i in use if len(text[i]) > 1), key=lambda i: (-v.scores[i], i))
        self.order = np.full(n, -1, dtype=np.int64)  # rank of the merge that makes a piece; -1 of characters
        self.order[order] = np.arange(len(order))
        self.left, self.right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        ids = {t: i for i, t in text.items()}
        if v.bpe:
            made = []
            for i in use:
                t = text[i]
                if len(t) == 1:
                    made.append(i)
                elif (pair := self._last_merge(t)) is not None:
                    self.left[i], self.right[i] = ids.get(pair[0], -1), ids.get(pair[1], -1)
                    if self.left[i] >= 0 and self.right[i] >= 0:
                        made.append(i)
            use = made
        self.cuttable = not any((" " in text[i].lstrip(" ")) or "\n" in text[i] for i in ids.values())
        self.hash = np.zeros(n, dtype=np.uint64)
        self.power = np.ones(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in ids.values():
                h, p = np.uint64(0), np.uint64(1)
                for b in v.pieces[i]:
                    h, p = h * _B + np.uint64(b + 1), p * _B
                self.hash[i], self.power[i] = h, p
        some = np.array(order, dtype=np.int64)
        self.unions = Table(self.hash[some], self.order[some])
        self._automaton(use)
        self.length = np.array([len(p) for p in v.pieces], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(v.pieces), dtype=np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.memo_keys, self.memo = np.zeros(0, np.uint64), np.zeros(0, bool)

    def _last_merge(self, t: str) -> tuple[str, str] | None:
        """The two parts whose merge makes t when t is encoded by itself; None if it ends otherwise."""
        mine = self.rank.pop(t)
        parts = merge(t, self.rank)
        self.rank[t] = mine
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _automaton(self, use: list[int]) -> None:
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in use:
            at = 0
            for b in self.v.pieces[i]:
                if (to := child[at].get(b)) is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    piece.append(-1)
                at = to
            piece[at] = i
        fail, out, queue = [0] * len(child), [0] * len(child), list(child[0].values())
        for at in queue:
            out[at] = fail[at] if piece[fail[at]] >= 0 else out[fail[at]]
            for b, to in child[at].items():
                f = fail[at]
                while f and b not in child[f]:
                    f = fail[f]
                fail[to] = child[f].get(b, 0)
                queue.append(to)
        keys = np.array([at << 8 | b for at, c in enumerate(child) for b in c], dtype=np.uint64)
        self.goto = Table(keys, np.array([to for c in child for to in c.values()], dtype=np.int64))
        self.fail, self.piece = np.array(fail), np.array(piece)
        self.next_out = np.array(out)  # output link: the longest proper suffix that is a piece
        self.first_out = np.where(self.piece >= 0, np.arange(len(child)), self.next_out)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        to = self.goto.get(state.astype(np.uint64) << np.uint64(8) | byte)
        todo = np.flatnonzero((to < 0) & (state > 0))
        at = state.copy()
        while len(todo):
            at[todo] = self.fail[at[todo]]
            to[todo] = self.goto.get(at[todo].astype(np.uint64) << np.uint64(8) | byte[todo])
            todo = todo[(to[todo] < 0) & (at[todo] > 0)]
        return np.maximum(to, 0)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether piece x followed by y stays so under merging, with a memory of answers."""
        key = x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)
        if not len(self.memo):
            self.memo_keys, self.memo = np.full(_MEMO, np.iinfo(np.uint64).max, np.uint64), np.zeros(_MEMO, bool)
        slot = (mix(key) & np.uint64(_MEMO - 1)).astype(np.int64)
        out = self.memo[slot]
        todo = np.flatnonzero(self.memo_keys[slot] != key)
        if len(todo):
            out[todo] = self._apart(x[todo], y[todo])
            self.memo_keys[slot[todo]], self.memo[slot[todo]] = key[todo], out[todo]
            # Two keys of this call may share a slot: keep what was computed for the key that stays.
            stay = self.memo_keys[slot[todo]] == key[todo]
            self.memo[slot[todo[stay]]] = out[todo[stay]]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges of a's last and b's first part, latest first; the pair fails if two parts that stood side by side would have merged before."""
        ok = np.ones(len(a), dtype=bool)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.unions.get(self.hash[x] * self.power[y] + self.hash[y])
            bad = (r >= 0) & (r < limit[live])
            ok[live[bad]] = False
            ra, rb = self.order[x], self.order[y]
            first = ra > rb
            going = ~bad & ((ra >= 0) | (rb >= 0))
            limit[live] = np.where(first, ra, rb + 1)
            a[live[first]] = self.right[x[first]]
            b[live[~first & going]] = self.left[y[~first & going]]
            live = live[going]
        return ok

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a segment) of byte strings that no piece crosses the border of."""
        n = len(segments)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(segments[i] for i in order), dtype=np.uint8)
        base = np.cumsum(size) - size
        slots = base + np.arange(n)  # a segment has a slot for each of its prefixes, the empty one included
        last = np.full(len(data) + n, _NONE, dtype=np.int64)
        width = np.zeros(len(data) + n, dtype=np.int64)
        best = np.full(len(data) + n, -np.inf)
        best[slots] = 0
        last[slots] = 0
        # Where characters begin, and how long the character is that ends at a byte.
        lead = (data & 0xC0) != 0x80
        begin = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) if len(data) else data
        ends = np.ones(len(data), dtype=bool)
        if len(data):
            ends[:-1] = lead[1:]
        state = np.zeros(n, dtype=np.int64)
        for p in range(int(size[0]) if n else 0):
            m = int(np.searchsorted(-size, -p, side="left"))
            at = base[:m] + p
            state = self.step(state[:m], data[at].astype(np.uint64))
            here = slots[:m] + p + 1
            link = self.first_out[state]
            todo = np.flatnonzero(link)
            while len(todo):
                piece = self.piece[link[todo]]
                before = here[todo] - self.length[piece]
                prev = last[before]
                fits = prev != _NONE
                if self.v.bpe:
                    fits &= ends[at[todo]]
                    ask = np.flatnonzero(fits & (before > slots[todo]) & (prev >= 0))
                    if len(ask):
                        fits[ask] = self.apart(prev[ask], piece[ask])
                else:
                    total = best[before] + self.v.scores[piece]
                    fits &= total > best[here[todo]]
                    best[here[todo[fits]]] = total[fits]
                won = todo[fits]
                last[here[won]], width[here[won]] = piece[fits], self.length[piece[fits]]
                link[todo] = self.next_out[link[todo]]
                todo = todo[~fits] if self.v.bpe else todo
                todo = todo[link[todo] > 0]
            # A character that is no piece stands alone, as bytes.
            lone = np.flatnonzero((last[here] == _NONE) & ends[at])
            if len(lone):
                k = at[lone] - begin[at[lone]] + 1
                before = here[lone] - k
                good = last[before] != _NONE
                lone, k, before = lone[good], k[good], before[good]
                last[here[lone]], width[here[lone]], best[here[lone]] = _UNKNOWN, k, best[before] + self.v.scores.min() - 10
        # Backwards from the end of every segment.
        at, live, found = slots + size, np.flatnonzero(size), []
        while len(live):
            here = at[live]
            found.append((live, here - width[here] - slots[live], last[here], width[here]))
            at[live] -= width[here]
            live = live[at[live] > slots[live]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        seg, pos, piece, k = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((pos, order[seg]))
        seg, pos, piece, k = seg[by], pos[by], piece[by], k[by]
        times = np.where(piece == _UNKNOWN, k, 1)
        ids = np.repeat(piece, times)
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)
        odd = ids == _UNKNOWN
        ids[odd] = self.v.byte_ids[data[(np.repeat(base[seg] + pos, times) + nth)[odd]]]
        return ids, np.bincount(np.repeat(order[seg], times), minlength=n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids a text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        texts = pc.replace_substring(texts, "▁", " ")
        filled = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", filled)
        data, offsets = text_bytes(texts)
        start = np.zeros(len(data), dtype=bool)
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        if len(data) and self.cuttable:
            blank, line = data == 32, data == 10
            start[1:] |= (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
        _, first, back = np.unique(_hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[starts[i] : ends[i]] for i in first]
        # Equal ranks (runs of blanks) need merging from left to right as written.
        slow = [self.v.bpe and (s.startswith(b"  ") or len(s) > 4096) for s in distinct]
        ids, count = self.encode_segments([b"" if z else s for s, z in zip(distinct, slow)])
        if any(slow):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i, z in enumerate(slow):
                if z:
                    parts[i] = self._merged(distinct[i])
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts])
        at = np.cumsum(count) - count
        n = count[back]
        flat = ids[np.repeat(at[back] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else ids
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        return flat, np.bincount(text_of, weights=n, minlength=len(offsets) - 1).astype(np.int64)

    @lru_cache(maxsize=10_000)
    def _merged(self, segment: bytes) -> np.ndarray:
        if not hasattr(self, "ids"):
            self.ids = {p.decode(): i for i, p in enumerate(self.v.pieces) if self.v.normal[i] and p}
        out: list[int] = []
        for t in merge(segment.decode(), self.rank):
            i = self.ids.get(t)
            out += [i] if i is not None else [int(self.v.byte_ids[b]) for b in t.encode()]
        return np.array(out, dtype=np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The texts of flat ids: piece bytes in order, without the first blank; broken UTF-8 becomes U+FFFD."""
        n = self.length[ids]
        data = self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(ids) else np.zeros(0, np.uint8)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(count)] if len(count) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        raw = data.tobytes()
        out = [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.array([x.decode("utf-8", "replace") for x in out], pa.string())


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """The encoder of a model file's content, built once a process."""
    if model not in _ENCODERS:
        _ENCODERS[model] = Encoder(Vocabulary.load(model))
    return _ENCODERS[model]


def read_model(path: str) -> bytes:
    """The model file as the driver sees it; its content, of bounded size, travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, key: str = "doc_id", text: str = "text", verify: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row, with `round_trip` (decoding gives the text back) if verify is set.

    Null and empty texts have no ids; characters that are no piece become
    their UTF-8 bytes; U+2581 is encoded as a blank, as the format has it, and
    so is not given back.  Texts of any length are encoded as a whole; repeated
    rows are rows of their own; an empty table gives no rows; other columns are
    left out.
    """
    content = read_model(model)

    def run(batches):
        enc = encoder_of(content)
        for part in text_slices(batches, "text", 3 << 20):
            ids, count = enc.encode(part.column(1))
            columns = [part.column(0), pa.array(count), list_column(ids, count, pa.int32())]
            if verify:
                columns.append(pc.equal(enc.decode(ids, count), pc.fill_null(part.column(1), "")))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "round_trip"][: len(columns)])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids array<int>" + ", round_trip boolean" * verify)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, key: str = "id", ids: str = "ids") -> DataFrame:
    """(id, text): the texts of lists of ids; a null list is empty, null or unknown ids raise an error."""
    content = read_model(model)

    def run(batches):
        enc = encoder_of(content)
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), enc.decode(np.asarray(lists.flatten()).astype(np.int64), n)], names=["id", "text"])

    return encoded.select(F.col(key).cast("long").alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "id long, text string")
