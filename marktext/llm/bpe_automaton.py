"""Byte-level BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens.  It starts as one state with a loop for each byte, and every merge
(a, b) -> c, in order of rank, applies one gadget: all a-arcs are led into a copy of their
target that has lost its b-arc (after a, a plain b may no longer come), and where a then b
could be read before, a c-arc now leads to where b led.  All arcs labelled t end in one state,
so a state is named by the token read last, and the language is exactly the set of correct
tokenizations.  Every byte string has one of them, hence the run is deterministic.

Written out, 50,000 merges give a table of 2.5 thousand million possible arcs.  Its entries
are therefore filled when first needed: whether state x has an arc y follows from the gadgets
that made x and y, newest first (``_arc``).  Labels lie in a double array (node, byte -> node).  The
new pre-split words of a batch of texts walk both tables together, one numpy step for all of
them; a word whose run meets a dead end steps back and goes on.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, give_back, text_or_empty

# FIXED VALUES: the pre-split pattern of this kind of vocabulary, with \s written out as the
# Unicode White_Space characters.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+"
           rf"|[{_S}]+(?![^{_S}])|[{_S}]+")

#: What a Python worker remembers: words with their encoding (twice so many), the cuts seen first,
#: and slots for arcs of the table (a power of two, eight bytes each).
WORDS_KEPT, FIRST_KEPT, ARC_SLOTS = 50_000, 1 << 15, 1 << 20
#: Words that walk the tables together; from FEW words on the rest is walked one by one, as are longer ones.
TOGETHER, FEW, LONG = 1 << 16, 24, 64


@lru_cache(1)
def _byte_of_char() -> dict[str, int]:
    """Characters that stand for bytes in the file: printable bytes for themselves, the others
    for the characters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> dict:
    """Labels, merges and added tokens of a byte-level BPE ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, chars = spec["model"], _byte_of_char()
    pre = spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("expected a plain byte-level BPE without normaliser or prefix space")
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that strip or match whole words only are not supported")
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"labels": {i: bytes(chars[c] for c in t) for t, i in vocab.items()},
            "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "added": added}


class _Memory:
    """Remembers up to twice ``size`` keys: when the newer half is full, the older one goes, and
    keys in use come back from it meanwhile."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def find(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is not None:
                self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: bytes) -> None:
        if len(key) <= 64:
            if len(self.new) >= self.size:
                self.new, self.old = {}, self.new
            self.new[key] = ids


class TokenAutomaton:
    """Deterministic automaton over tokens, its arcs filled on demand from the merge gadgets."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int] | None = None):
        self.label = dict(labels)
        self.added = dict(added or {})
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
        self.parts = {c: (k, a, b) for k, (a, b, c) in enumerate(merges)}
        # A gadget adds arcs only where its left part and then its right part could be read; a
        # merge whose pair was taken apart by earlier ones makes no token.
        live = {t for t, label in labels.items() if len(label) == 1}
        for k, (a, b, c) in enumerate(merges):
            if a in live and b in live and self._arc(a, b, k):
                live.add(c)
        self.token = {label: t for t, label in labels.items() if t in live}
        if any(bytes([b]) not in self.token for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        # Labels as a tree of bytes (children, token), and each token's next shorter prefix token.
        self.tree: dict[int, tuple] = {}
        self.shorter: dict[int, int] = {}
        for label, t in sorted(self.token.items()):
            kids, last = self.tree, -1
            for b in label[:-1]:
                if b not in kids:
                    kids[b] = ({}, -1)
                kids, y = kids[b]
                last = y if y >= 0 else last
            self.shorter[t] = last
            kids[label[-1]] = (kids[label[-1]][0] if label[-1] in kids else {}, t)
        self.longest = max(map(len, self.token))
        self._compile()
        self.emits = arc_labels(self.label, self.added)
        self._words = regex.compile(PATTERN)
        self._runs = re.compile(rf"[{_S}](?=[{_S}]|\Z)")
        self._first: dict[str, bytes] = {}
        self._kept, self._cuts = _Memory(WORDS_KEPT), _Memory(WORDS_KEPT)
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _compile(self) -> None:
        """The tree as a double array: the child of a node by a byte is at its row's base plus the
        byte, if that place is owned by the node.  Nodes with children come first."""
        inner, leaves, queue = [], [], [(self.tree, -1, -1, -1)]
        for kids, t, up, b in queue:
            me = len(inner) if kids else -1 - len(leaves)
            (inner if kids else leaves).append((t, up, b, sorted(kids)))
            queue += [(under, y, me, byte) for byte, (under, y) in kids.items()]
        nodes, self._inner = inner + leaves, len(inner)
        self._tokens = np.array([t for t, *_ in nodes], np.int64)
        # Rows with many children find room first; those with one child fill the holes.  After
        # several places that do not fit, the part before is left to rows with one child.
        room, base, low = bytearray(256 * (len(inner) + 2)), [0] * len(inner), 0
        for node in sorted(range(len(inner)), key=lambda i: -len(inner[i][3])):
            kids, tries = inner[node][3], 0
            free = room.find(0, max(kids[0], low if len(kids) > 1 else 0))
            while any(room[free - kids[0] + b] for b in kids):
                free, tries = room.find(0, free + 1), tries + 1
            low = max(low, free) if tries > 8 else low
            base[node] = free - kids[0]
            for b in kids:
                room[base[node] + b] = 1
        self._base = np.array(base, np.int64)
        n = max(base) + 256
        self._owner, self._child = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for node, (_, up, b, _) in enumerate(nodes):
            if up >= 0:
                self._owner[base[up] + b], self._child[base[up] + b] = up, node
        n = max(self.label) + 1
        self._size, self._next = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for label, t in self.token.items():
            self._size[t], self._next[t] = len(label), self.shorter[t]
        # Slots of the arc table: a state and an arc as one number, twice, plus one if there is an arc.
        self._slots = np.full(ARC_SLOTS, -1, np.int64)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the state after token x[i] has an arc y[i] in the finished automaton."""
        key = (x << 32) | y
        # Multiplied by an odd number, the upper bits depend on all of x and y.
        slot = ((key * -7046029254386353131) >> 40) & (len(self._slots) - 1)
        found = self._slots[slot]
        unknown = np.flatnonzero(found >> 1 != key)
        if len(unknown):
            new, place = np.unique(key[unknown], return_inverse=True)
            known = np.array([k << 1 | self._arc(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
            found[unknown] = known[place]
            self._slots[slot[unknown]] = found[unknown]
        return (found & 1).astype(bool)

    def _longest_at(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that stands at each place, not beyond its end."""
        best, who = np.empty(len(at), np.int64), np.arange(len(at))
        node = np.zeros(len(at), np.int64)
        while len(who):
            place = self._base[node] + data[at]
            on = self._owner[place] == node
            who, node, at, end = who[on], self._child[place[on]], at[on] + 1, end[on]
            t = self._tokens[node]
            has = t >= 0
            best[who[has]] = t[has]
            on = (node < self._inner) & (at < end)
            who, node, at, end = who[on], node[on], at[on], end[on]
        return best

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-split words, none empty: the runs of ``encode_word``, a step at a time for all."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            out += self._walk(words[i:i + TOGETHER])
        return out

    def _walk(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        start = np.concatenate((np.zeros(1, np.int64), end[:-1]))
        # A word has no more tokens than bytes, so both share its stretch of places.
        ids, dead = np.zeros(len(data), np.int64), np.zeros(len(data) + 1, bool)
        at, top = start.copy(), start.copy()
        who = np.flatnonzero(end - start <= LONG)
        alone = np.flatnonzero(end - start > LONG).tolist()
        y = self._longest_at(data, at[who], end[who])
        while len(who) > FEW:
            a, k = at[who], top[who]
            stuck = y < 0
            to = a + self._size[y]
            ok = ~stuck
            ok[ok] = ~dead[to[ok]]
            follows = np.flatnonzero(ok & (k > start[who]))
            ok[follows] = self.arcs(ids[k[follows] - 1], y[follows])
            # On: the arc is taken.
            go = np.flatnonzero(ok)
            w = who[go]
            ids[k[go]] = y[go]
            at[w], top[w] = to[go], k[go] + 1
            # Back: no arc leads on from this place, whatever came before; its last arc is taken back.
            back = np.flatnonzero(stuck)
            w = who[back]
            dead[a[back]] = True
            top[w] = k[back] - 1
            last = ids[top[w]]
            at[w] = a[back] - self._size[last]
            # What to try next: the longest token at the new place, else the next shorter one.
            y = self._next[y]
            y[back] = self._next[last]
            left = at[who] < end[who]
            go = go[left[go]]
            y[go] = self._longest_at(data, at[who[go]], end[who[go]])
            who, y = who[left], y[left]
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * i:4 * j] for i, j in zip(start.tolist(), top.tolist())]
        for i in [*alone, *who.tolist()]:
            out[i] = self._pack(self.encode_word(words[i]))
        return out

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def _arc(self, x: int, y: int, before: int = 1 << 62) -> bool:
        """Whether x had an arc y when only the gadgets of rank below ``before`` had been applied."""
        byte = (-1, -1, -1)
        while True:
            if self.rank.get((x, y), before) < before:
                return False  # the gadget of (x, y) took this arc away
            (kx, _, right), (ky, left, own) = self.parts.get(x, byte), self.parts.get(y, byte)
            if kx < 0 and ky < 0:
                return True  # the loops of the first state
            if kx > ky:  # x is newer: its state is where its right part led before the gadget
                before, x = kx, right
            elif ky > kx:  # y is newer: its arcs start where its left part's did ...
                if left == own == x:
                    return False  # ... but for (a, a): the state after a has lost its a-arc
                before, y = ky, left
            else:
                before, x, y = kx, right, left

    def encode_word(self, word: bytes) -> list[int]:
        """The one tokenization of a pre-split word: the run of the automaton over its bytes.

        Arcs are tried longest first.  There is one tokenization of every prefix, so a byte
        position is reached in one way only; one from which the run cannot go on is dead for good.
        """
        n, at, out = len(word), 0, []
        tree, shorter, label = self.tree, self.shorter, self.label
        dead, fresh = set(), True
        while at < n:
            if fresh:  # the longest token that stands here
                kids, y = tree, -1
                for b in word[at:] if n - at < 64 else word[at:at + self.longest]:
                    node = kids.get(b)
                    if node is None:
                        break
                    kids, t = node
                    if t >= 0:
                        y = t
            while y >= 0:
                if not out or self._arc(out[-1], y):
                    to = at + len(label[y])
                    if to not in dead:
                        break
                y = shorter[y]
            if y >= 0:
                out.append(y)
                at, fresh = to, True
            else:  # a dead end: take the last arc back and try its next shorter neighbour
                dead.add(at)
                last = out.pop()
                at, y, fresh = at - len(label[last]), shorter[last], False
        return out

    def _words_of(self, text: str) -> bytes:
        """Ids of a text: pre-split, then each word by the automaton or from memory."""
        parts = []
        for w in self._words.findall(text):
            ids = self._kept.find(w)
            if ids is None:
                ids = self._pack(self.encode_word(w.encode("utf-8")))
                self._kept.keep(w, ids)
            parts.append(ids)
        return b"".join(parts)

    def _look_up(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of a space and each cut of the texts.  New cuts are split into words, and the words
        not remembered walk the tables together.  The cuts seen first are mostly the frequent ones;
        they have a table of their own, of which nothing goes."""
        cuts: set[str] = set()
        for t in texts:
            cuts.update(t.split(" "))
        cuts.discard("")
        found, new = {}, []
        for c in cuts:
            ids = self._first.get(c) or self._cuts.find(c)
            if ids is None:
                new.append(c)
            else:
                found[c] = ids
        split = [self._words.findall(" " + c) for c in new]
        words: dict[str, bytes | None] = dict.fromkeys(w for ws in split for w in ws)
        for w in words:
            words[w] = self._kept.find(w)
        lacking = [w for w, ids in words.items() if ids is None]
        for w, ids in zip(lacking, self.encode_words([w.encode("utf-8") for w in lacking])):
            words[w] = ids
            self._kept.keep(w, ids)
        for c, ws in zip(new, split):
            found[c] = ids = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
            if len(self._first) < FIRST_KEPT and len(c) <= 64:
                self._first[c] = ids
            else:
                self._cuts.keep(c, ids)
        return found

    def _packed(self, text: str, known: dict[str, bytes]) -> bytes:
        """Ids of a text without added tokens; ``known`` holds those of its cuts.

        No pre-split word reaches across a space with other characters than white space on both
        sides, so the text is cut there and whole cuts are remembered.  Around longer runs of
        white space the stretch from the last to the next such space is taken as it is.
        """
        out, at, n = [], 0, len(text)
        rough: list[list[int]] = []
        for m in self._runs.finditer(text):
            if rough and m.start() <= rough[-1][1]:
                a = rough.pop()[0]
            else:
                a = max(text.rfind(" ", rough[-1][1] if rough else 0, m.start()), rough[-1][1] if rough else 0)
            b = text.find(" ", m.end())
            rough.append([a, n if b < 0 else b])
        for a, b in [*rough, [n, n]]:
            if at < a:
                smooth = text[at:a].split(" ")
                if smooth[0]:  # the start of the text: no space before it
                    out.append(self._words_of(smooth[0]))
                found = list(map(known.get, smooth[1:]))
                if None in found:  # next to an added token
                    found = [self._words_of(" " + c) if ids is None else ids for c, ids in zip(smooth[1:], found)]
                out += found
            if a < b:
                out.append(self._words_of(text[a:b]))
            at = b
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` for several texts at once."""
        known = self._look_up(texts)
        return [self._encode(t, known) for t in texts]

    def _encode(self, text: str, known: dict[str, bytes]) -> bytes:
        out, at = [], 0
        for m in self._split.finditer(text) if self._split else ():
            out += [self._packed(text[at:m.start()], known), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        out.append(self._packed(text[at:] if at else text, known))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return emit(self.emits, ids)


def arc_labels(labels: dict[int, bytes], added: dict[str, int]) -> dict[int, bytes]:
    """What each arc emits when token ids are decoded."""
    return {**labels, **{i: s.encode() for s, i in added.items()}}


def emit(labels: dict[int, bytes], ids: bytes) -> str:
    """The labels of the arcs, joined; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_AUTOMATA: dict[str, TokenAutomaton] = {}


def _automaton(spec) -> TokenAutomaton:
    """The automaton of a broadcast specification; a Python worker keeps the last one."""
    key, parts = spec.value
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = TokenAutomaton(**parts)
    return _AUTOMATA[key]


def _share(df: DataFrame, path: str):
    # A vocabulary file is a model of fixed size (a few MB), not data.
    parts = read_tokenizer(path)
    key = hashlib.sha256(repr(sorted(parts["labels"].items())).encode() + repr(parts["merges"]).encode()
                         + repr(parts["added"]).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((key, parts))


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids",
               decoded_col: str | None = None) -> DataFrame:
    """``docs`` plus ``out_col``: the text's token ids, packed as little-endian unsigned 32-bit
    integers (the layout of token files).  With ``decoded_col`` also the text decoded from these
    ids again, in the same pass.

    Null texts encode as empty.  Strings of added tokens in a text become these tokens, as the
    tokenizers library does by default.  Rows keep their place and number; columns of ``docs``
    named like the new ones are replaced.  Words are encoded whole, however long, and texts one
    at a time.
    """
    new = [out_col, *([decoded_col] if decoded_col else [])]
    spec = _share(docs, tokenizer)
    others = [c for c in docs.columns if c not in new]
    rows = docs.select(*[column(c) for c in others], text_or_empty(text_col).alias(out_col))
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(spec)
        for b in batches:
            for part in _pieces(b, at):
                ids = auto.encode_all(part.column(at).to_pylist())
                made = [pa.array(ids, pa.binary())]
                if decoded_col:
                    made.append(pa.array(map(auto.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], names=[*part.schema.names[:at], *new])
        give_back()

    kinds = [T.StructField(out_col, T.BinaryType()), T.StructField(decoded_col or "", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:at], *kinds[:len(new)]]))


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` plus ``out_col``: the text that the packed ids stand for (null ids: empty)."""
    spec = _share(rows, tokenizer)
    others = [c for c in rows.columns if c != out_col]
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(spec.value[1]["labels"], spec.value[1]["added"])
        for b in batches:
            for part in _pieces(b, at):
                text = pa.array([emit(labels, t.as_py()) for t in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], text], names=part.schema.names)

    out = rows.select(*[column(c) for c in others], F.coalesce(column(ids_col), F.lit(b"")).alias(out_col))
    return out.mapInArrow(run, T.StructType([*out.schema.fields[:at], T.StructField(out_col, T.StringType())]))


def _pieces(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column ``at`` holds about ``most`` bytes, one row at least."""
    import pyarrow.compute as pc
    sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
