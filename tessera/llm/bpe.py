"""BPE encoding and decoding with a tokenization automaton.

The automaton runs over token labels and accepts exactly the correct tokenizations. It is compiled
by successive merge gadgets: starting from one state with an arc for each base symbol, the merge
``a b -> ab`` (1) lets the ``a`` arcs lead to a copy of their target that has no ``b`` arc, since
``a`` can no longer be followed by ``b``, and (2) adds an ``ab`` arc wherever ``a`` could be followed
by ``b``, leading where that ``b`` led. Where an arc leads depends on its label only, so a gadget adds
one state and one label. A copied state shares all but the missing arc with the state it was copied
from; ``allows`` follows those copies and fills a transition table on the way.

A word's prefixes each have exactly one accepted path, so encoding keeps one state per position and
never backtracks; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import map_batches, replace_columns, replaced_schema, slices

#: Distinct white-space-free chunks, and words, in each of the two generations a worker remembers.
CACHE_CHUNKS = 130_000


#: (state, token) pairs whose arcs the automaton's transition table holds at most; it is emptied when full.
TABLE_ARCS = 1 << 18


class Remembered(dict):
    """Results by key, in two generations: what was used lately survives when memory is full.

    A key is kept from its second sight on, so the many that occur once take no room.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.seen = make, {}, bytearray(1 << 22)

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            at = hash(key) & ((1 << 22) - 1)
            if not self.seen[at]:
                self.seen[at] = 1
                return found
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
            self.seen = bytearray(1 << 22)
        self[key] = found
        return found


#: Unicode white space, as the vocabulary's normalizer understands it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: str.split() also cuts at these, which are not white space to the normalizer.
_SPLIT_ONLY = regex.compile("[\x1c-\x1f]")
_NOT_WHITE = regex.compile(f"[^{_WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class TokenizationAutomaton:
    """Compiled merges of a BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        self.ids = vocab
        produced = {a + b for a, b in merges}
        # By token id: the merge that made it (0: base symbol), its left part, the state it leads to.
        size = max(vocab.values(), default=-1) + 1
        self.made, self.left, self.target = [0] * size, [-1] * size, [0] * size
        self.usable = [False] * size
        for token, i in vocab.items():
            self.usable[i] = token not in produced
        # Copies made for one label form a run; by run: the state it began from, the states, when each
        # was made, and when each label was lost. By state: its run and when it was made.
        self.runs: list[tuple[int, list[int], list[int], dict[int, int]]] = []
        self.run_of, self.born, self.own_run = [-1], [0], {}
        self.table: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.table.clear()
        # Spelling of the labels as a table: node * 512 + symbol -> node; by node, the label that ends there.
        self.spelling: dict[int, int] = {}
        self.ends = [-1]
        code = {c: b for b, c in enumerate(byte_symbols())}
        for token, i in vocab.items():
            body, last = (token[: -len(suffix)], 256) if suffix and token.endswith(suffix) else (token, 0)
            if not self.usable[i] or not body or any(c not in code for c in body):
                continue
            node = 0
            for k, c in enumerate(body, 1):
                key = node * 512 + code[c] + (last if k == len(body) else 0)
                node = self.spelling.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i

    def _gadget(self, time: int, a: int, b: int, ab: int) -> None:
        if not (self.usable[a] and self.usable[b]) or not self.allows(self.target[a], b):
            return
        follow = self.target[b]
        if a not in self.own_run:
            self.own_run[a] = len(self.runs)
            self.runs.append((self.target[a], [], [], {}))
        _, states, born, lost = self.runs[self.own_run[a]]
        state = len(self.born)
        states.append(state)
        born.append(time)
        lost[b] = time
        self.run_of.append(self.own_run[a])
        self.born.append(time)
        self.target[a] = state
        if not self.usable[ab]:
            self.usable[ab], self.made[ab], self.left[ab], self.target[ab] = True, time, a, follow

    def allows(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``."""
        s, t = state, token
        while s:
            origin, states, born, lost = self.runs[self.run_of[s]]
            when = lost.get(t)
            if when is not None and when <= self.born[s]:
                return False
            made = self.made[t]
            if born[0] > made:
                s = origin
            else:  # added after that copy was made: present where its left part is
                s = states[bisect_right(born, min(made, self.born[s])) - 1]
                t = self.left[t]
        return True

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        """Token ids of one pre-split word, given as bytes; 256 is added to one that ends a word."""
        n = len(symbols)
        states = [0] + [-1] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        spelling, ends, table, target = self.spelling, self.ends, self.table, self.target
        for i in range(n):
            state = states[i]
            if state < 0:
                continue
            node = 0
            for j in range(i, n):
                node = spelling.get(node * 512 + symbols[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and states[j + 1] < 0:
                    key = state << 20 | token
                    ok = table.get(key)
                    if ok is None:
                        if len(table) >= TABLE_ARCS:
                            table.clear()
                        ok = table[key] = self.allows(state, token)
                    if ok:
                        states[j + 1], back[j + 1] = target[token], (i, token)
        out, at = [], n
        while at:
            if back[at] is None:
                raise ValueError(f"the vocabulary has no symbol for {symbols!r}")
            at, token = back[at]
            out.append(token)
        return out[::-1]


class WordTokenizer:
    """A vocabulary file of word-end BPE with its normalizer, pre-splitter and special tokens."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = TokenizationAutomaton(model["vocab"], merges, self.suffix)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.plain = all("<" in t for t in self.special)
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.chunks, self.known = Remembered(self._chunk), Remembered(self._word)

    @staticmethod
    def _lower(text: str) -> str:
        # Letter by letter where the whole-string rule differs: capital sigma has a form for word ends.
        return "σ".join(p.lower() for p in text.split("Σ")) if "Σ" in text else text.lower()

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        return self.known[word]

    def _word(self, word: str) -> list[int]:
        symbols = list(word.encode())
        if self.suffix:
            symbols[-1] += 256
        return self.automaton.encode_symbols(symbols)

    def _ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.special_split.split(chunk) if "<" in chunk or not self.plain else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                for word in self.words.findall(self._lower(part)):
                    out += self.known[word]
        return out

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids and labels of a stretch without white space; ids and labels are space-joined."""
        ids = self._ids(chunk)
        return len(ids), " ".join(map(str, ids)), " ".join(self.decode_labels(ids))

    def decode_labels(self, ids: list[int]) -> list[str]:
        return [self.labels[i] for i in ids]

    def encode(self, text: str) -> list[int]:
        ids = self.render(text)[1]
        return [int(x) for x in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined by a space: the vocabulary file names no other decoder."""
        return " ".join(self.decode_labels(ids))

    def render(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by a space, the decoded text."""
        chunks = _NOT_WHITE.findall(text) if _SPLIT_ONLY.search(text) else text.split()
        known = self.chunks
        found = [x for c in chunks if (x := known[c])[0]]
        return sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(key: str, spec: bytes) -> WordTokenizer:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(spec)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text with the vocabulary file at path ``vocabulary``, then decode the ids.

    Adds ``n_tokens`` long, ``token_ids`` array<int> and ``decoded`` string to the rows (input columns
    of these names are replaced); with ``digests`` it adds ``ids_sha256`` and ``decoded_sha256``
    (lowercase hex; ids in decimal, joined by one space) instead of the arrays and texts.

    A null text counts as empty; an empty text, or one of white space only, has no ids and decodes to
    the empty string. Repeated rows are encoded each by itself. There is no shuffle: rows stay where
    they are; an empty table gives an empty result. The vocabulary is read on the driver (a few MB whatever the corpus) and broadcast;
    workers compile it once. Its memory of encoded chunks is bounded and affects speed only.
    """
    with open(vocabulary, "rb") as f:
        spec = f.read()
    key = hashlib.sha256(spec).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    fields = [T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(key, shared.value)
        for part in slices(batches):
            done = [tok.render(t or "") for t in part.column(text_col).to_pylist()]
            columns = {"n_tokens": pa.array([n for n, _, _ in done], pa.int64())}
            if digests:
                columns["ids_sha256"] = pa.array([hashlib.sha256(i.encode()).hexdigest() for _, i, _ in done], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for _, _, d in done], pa.string())
            else:
                ids = [[int(x) for x in i.split(" ")] if i else [] for _, i, _ in done]
                columns["token_ids"] = pa.array(ids, pa.list_(pa.int32()))
                columns["decoded"] = pa.array([d for _, _, d in done], pa.string())
            yield replace_columns(part, columns)

    return map_batches(docs, run, replaced_schema(docs, fields))
