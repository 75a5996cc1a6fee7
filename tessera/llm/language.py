"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text is compiled. A text is parsed against
it: each phrase is the longest match of the text's next letters that occurs in the language's text.
The phrase count, normalised by length, estimates the cross entropy (Ziv and Merhav); the language
that needs the fewest normalised phrases wins.

Whole texts are parsed as one sequence each. To use vectors, a text is entered at many places at once:
a walk that begins a little before a place guesses where a phrase begins after it, as walks soon fall into
step. Where a walk that comes from before proves the guess wrong, that stretch is walked again, so
the phrases are exactly those of the parse from the text's first letter on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, replace_columns, replaced_schema, sample_ids, slices

#: Letters of labelled text that a language's automaton is built from, at most.
SAMPLE_LETTERS = 60_000
#: Labelled documents of each language drawn for it at most (by id hash).
SAMPLE_DOCUMENTS = 64
#: Labelled documents are sampled by pieces of this many letters.
PIECE = 512
#: One of so many sampled pieces is kept out of the automaton, to see what texts of the language cost.
CALIBRATION = 8
#: A text of ``LEAST_LETTERS`` is not recognised if it costs more than this many times the dearest of those pieces.
MARGIN, LEAST_LETTERS = 2.0, 100
#: A text is entered every ``STRIDE`` letters, by walks that begin ``LEAD`` letters before.
STRIDE, LEAD = 1024, 48
#: Letters of texts that are parsed together, about.
BATCH_LETTERS = 1 << 22
UNDETERMINED = "und"


@dataclass
class Automaton:
    """A suffix automaton in a displaced table: the arc of ``state`` by ``c`` lies at ``base[state] + c`` if ``owner`` there says so."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    letters: int

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States reached by an arc each, or -1."""
        at = self.base[state] + c
        return np.where(self.owner[at] == state, self.to[at], -1)

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.owner.nbytes + self.to.nbytes


@dataclass
class Languages:
    names: list[str]  # sorted
    symbol: np.ndarray  # by code point: 0 no letter (a gap), else the letter's symbol; one symbol is for all unseen
    automata: list[Automaton]  # by language
    dearest: np.ndarray  # by language: bits a letter up to which a text is recognised


def suffix_arcs(text: np.ndarray) -> list[dict[int, int]]:
    """Arcs of the suffix automaton of a sequence of symbols, by state; state 0 is the start."""
    arcs: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return arcs


def automaton(text: np.ndarray, symbols: int) -> Automaton:
    """The suffix automaton of a sequence of symbols below ``symbols``.

    A suffix automaton has fewer than three arcs for each letter of its text, and the table at most two places
    for each arc, however many symbols there are. States of several arcs are put at places drawn
    until all their arcs fit, the larger ones first; states of one arc fill the places left.
    """
    arcs = suffix_arcs(text)
    degree = np.fromiter(map(len, arcs), np.int64, len(arcs))
    c = np.fromiter((x for found in arcs for x in found), np.int64, int(degree.sum()))
    to = np.fromiter((x for found in arcs for x in found.values()), np.int64, len(c))
    first = np.cumsum(degree) - degree
    pending = np.flatnonzero(degree > 1)
    pending = pending[np.argsort(-degree[pending], kind="stable")]
    many, single = int(degree[pending].sum()), np.flatnonzero(degree == 1)
    places = max(2 * many, many + len(single)) + symbols
    base = np.zeros(len(arcs), np.int32)
    owner, target = np.full(places + 2 * symbols, -1, np.int32), np.full(places + 2 * symbols, -1, np.int32)
    rng, rounds = np.random.default_rng(42), 0
    while len(pending):
        rounds += 1
        if rounds % 64 == 0:  # crowded: more room
            places += many + symbols
            owner, target = (np.concatenate([x, np.full(many + symbols, -1, np.int32)]) for x in (owner, target))
        drawn = rng.integers(symbols, places, len(pending))
        n = degree[pending]
        who = np.repeat(np.arange(len(pending)), n)
        arc = np.repeat(first[pending] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        slot = drawn[who] + c[arc]
        claim = np.full(len(owner), len(pending))
        np.minimum.at(claim, slot, who)
        fits = np.bincount(who, (owner[slot] >= 0) | (claim[slot] != who), len(pending)) == 0
        put = fits[who]
        owner[slot[put]], target[slot[put]] = pending[who[put]], to[arc[put]]
        base[pending[fits]] = drawn[fits]
        pending = pending[~fits]
    left = symbols + np.flatnonzero(owner[symbols:] < 0)[: len(single)]
    base[single] = left - c[first[single]]
    owner[left], target[left] = single, to[first[single]]
    return Automaton(base, owner, target, len(text))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def letters_only(symbols: np.ndarray) -> np.ndarray:
    """Symbols with each run of non-letters made one gap."""
    gap = symbols == 0
    return symbols[~(gap & np.concatenate(([True], gap[:-1])))] if len(symbols) else symbols


def is_letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces_of(text: str, letter: np.ndarray) -> list[str]:
    """Pieces of ``PIECE`` letters of a text from anywhere in it, in an order that its hash seeds: ``SAMPLE_LETTERS`` at most."""
    points = code_points(text)
    plain = letters_only(np.where(letter[points], points, 0).astype("<u4"))
    pieces = [plain[at : at + PIECE] for at in range(0, len(plain), PIECE)]
    order = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode())).permutation(len(pieces))
    return [pieces[k].tobytes().decode("utf-32-le").replace("\0", " ") for k in order[: SAMPLE_LETTERS // PIECE + 1]]


def learn(samples: dict[str, list[str]]) -> Languages:
    """Automata from texts by language: of their pieces, in seeded random order, ``SAMPLE_LETTERS`` letters."""
    letter = is_letter_table()
    return learn_pieces({name: [p for t in found for p in pieces_of(t, letter)] for name, found in samples.items()})


def learn_pieces(samples: dict[str, list[str]]) -> Languages:
    """Automata from pieces of text by language.

    A symbol that no text has lies between the pieces, so no match runs over a joint.
    """
    letter = is_letter_table()
    pieces = {name: [code_points(p) for p in found] for name, found in sorted(samples.items())}
    seen = np.unique(np.concatenate([np.zeros(0, "<u4"), *(p[letter[p]] for found in pieces.values() for p in found)]))
    unseen, joint = len(seen) + 1, len(seen) + 2
    symbol = np.zeros(0x110000, np.int32)
    symbol[letter] = unseen
    symbol[seen] = np.arange(1, unseen)
    names, automata, dearest = [], [], []
    for name, found in pieces.items():
        order = np.random.default_rng(42).permutation(len(found))
        parts, kept, size = [], [], 0
        for n, k in enumerate(order.tolist()):
            if n % CALIBRATION == CALIBRATION - 1:
                kept.append(letters_only(symbol[found[k]]))
            elif size < SAMPLE_LETTERS:
                part = letters_only(symbol[found[k]])[: SAMPLE_LETTERS - size]
                parts += [part, np.array([joint], np.int32)]
                size += len(part)
        if not any(p.any() and (p != joint).any() for p in parts):
            continue
        machine = automaton(np.concatenate(parts), joint + 1)
        names.append(name)
        automata.append(machine)
        kept = [p for p in kept if len(p) >= LEAST_LETTERS]
        cost = phrase_counts(kept, machine) * bits(machine) / np.array([len(p) for p in kept]) if kept else np.array([np.inf])
        dearest.append(MARGIN * float(cost.max()))
    return Languages(names, symbol, automata, np.array(dearest))


def bits(machine: Automaton) -> float:
    """Bits that say where in the language's text a phrase lies."""
    return float(np.log2(machine.letters + 1))


def walk(machine: Automaton, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks in step, each from a phrase that begins at ``start``.

    Returns how many phrases each begins before ``stop``, and where the first one after that begins (``end`` if none does).
    """
    phrases, exit_ = np.zeros(len(start), np.int64), np.minimum(start, end)
    lane = np.flatnonzero((start < stop) & (start < end))
    at, state = start[lane].copy(), np.zeros(len(lane), np.int64)
    stop, end = stop[lane], end[lane]
    while len(lane):
        c = flat[at]
        to = machine.follow(state, c)
        new = np.flatnonzero((to < 0) | (state == 0))  # a phrase begins here
        over = at[new] >= stop[new]
        phrases[lane[new[~over]]] += 1
        # A letter that the language lacks is a phrase by itself.
        to[new] = np.maximum(machine.follow(np.zeros(len(new), np.int64), c[new]), 0)
        at += 1
        at[new[over]] -= 1
        gone = at >= end
        gone[new[over]] = True
        state = to
        if gone.any():
            exit_[lane[gone]] = at[gone]
            stay = ~gone
            lane, at, state, stop, end = lane[stay], at[stay], state[stay], stop[stay], end[stay]
    return phrases, exit_


def walk_alone(machine: Automaton, flat: memoryview, start: int, stop: int, end: int) -> tuple[int, int]:
    """:func:`walk` for one walk."""
    base, owner, to = memoryview(machine.base), memoryview(machine.owner), memoryview(machine.to)
    phrases, state, at = 0, 0, start
    while at < end:
        slot = base[state] + flat[at]
        if state and owner[slot] == state:
            state = to[slot]
        else:
            if at >= stop:
                break
            phrases += 1
            slot = base[0] + flat[at]
            state = to[slot] if owner[slot] == 0 else 0
        at += 1
    return phrases, at


def phrase_counts(rows: list[np.ndarray], machine: Automaton) -> np.ndarray:
    """Phrases that each row of symbols needs, in a greedy parse from its first symbol on."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    begin = np.cumsum(lengths) - lengths
    n = -(-lengths // STRIDE)
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + place * STRIDE
    end = (begin + lengths)[row]
    stop = np.minimum(start + STRIDE, end)
    entry = start.copy()
    inner = np.flatnonzero(place > 0)
    entry[inner] = walk(machine, flat, start[inner] - LEAD, start[inner], end[inner])[1]
    phrases, exit_ = walk(machine, flat, entry, stop, end)
    wrong = np.unique(row[inner[entry[inner] != exit_[inner - 1]]])
    view = memoryview(flat)
    for r in wrong.tolist():  # from its first wrong guess on, a row is checked place by place
        first = int(np.searchsorted(row, r))
        at = int(exit_[first])
        for k in range(first + 1, first + int(n[r])):
            if entry[k] != at:
                phrases[k], exit_[k] = walk_alone(machine, view, at, int(stop[k]), int(end[k]))
            at = int(exit_[k])
    return np.bincount(row, phrases, len(rows)).astype(np.int64)


def parse(texts: list[str | None], model: Languages) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, confidence, and whether the text is recognised as written in that language."""
    rows = [letters_only(model.symbol[code_points(t or "")]) for t in texts]
    has_letter = np.array([bool(r.any()) for r in rows], dtype=bool)
    if not model.names:
        return [UNDETERMINED] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), bool)
    total = np.maximum([len(r) for r in rows], 1).astype(np.float64)
    cost = np.stack([phrase_counts(rows, m) * bits(m) / total for m in model.automata])
    best = cost.argmin(axis=0)
    at = np.arange(len(rows))
    low = cost[best, at]
    others = cost.copy()
    others[best, at] = np.inf
    second = others.min(axis=0) if len(model.names) > 1 else low * 2
    score = np.where(has_letter, 1 - low / np.maximum(second, 1e-12), 0.0)
    known = has_letter & ((low <= model.dearest[best]) | (total < LEAST_LETTERS))
    return [model.names[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], np.clip(score, 0, 1), known


def by_length(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of some ``BATCH_LETTERS``, or one text if it is longer: bounds a worker's memory."""
    group: list[str | None] = []
    size = 0
    for text in texts:
        if group and size + len(text or "") > BATCH_LETTERS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def train(docs: DataFrame, trainable: Column, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """Automata from the rows for which ``trainable`` holds, with a language, an id and a text that are not null.

    Bounded sample: ``SAMPLE_DOCUMENTS`` distinct ids of each language (lowest id hashes), of which
    ``SAMPLE_LETTERS`` letters enter its automaton, from anywhere in the texts. Of rows that repeat an id and
    language the one with the least text hash counts. A language without letters in its sample is not
    learned. What reaches the driver grows with the number of languages only.
    """
    usable = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col("doc_id").isNotNull())
    found = usable.select(F.col("doc_id").cast("string").alias("id"), F.col(lang_col).alias("class"), F.col(text_col).alias("text"))
    chosen = sample_ids(found.select("id", "class"), SAMPLE_DOCUMENTS)
    # SAMPLE_DOCUMENTS short rows for each language: a bounded side.
    joined = found.join(F.broadcast(chosen), ["id", "class"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, least = is_letter_table(), {}
        for part in slices(batches):
            for i, lang, text in zip(*(part.column(n).to_pylist() for n in ("id", "class", "text")), strict=True):
                key, rank = (i, lang), xxhash.xxh3_128_hexdigest(text.encode())
                if key not in least or rank < least[key][0]:
                    least[key] = (rank, pieces_of(text, letter))
        columns = [[k[0] for k in least], [k[1] for k in least], [x[0] for x in least.values()], [x[1] for x in least.values()]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "class", "rank", "pieces"])

    rows = map_batches(joined, cut, "id string, class string, rank string, pieces array<string>")
    rows = rows.groupBy("class", "id").agg(F.min_by("pieces", "rank").alias("pieces")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["class"], r["id"])):
        samples.setdefault(r["class"], []).extend(r["pieces"])
    return learn_pieces(samples)


def identify(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` string, ``score`` double (0 to 1: how far the next best language is behind), ``recognised`` boolean.

    Whole texts are parsed. ``und`` with score 0 where the text is null or has no letter, or no language
    was learned; ties go to the language that sorts first. ``recognised`` is false for ``und``, and for texts of
    ``LEAST_LETTERS`` or more that cost far more bits a letter than sampled text of the language found: such
    a text is probably in a language that was not learned. Input columns named like the output are
    replaced. Repeated rows are read each by itself; an empty table gives an empty result. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("recognised", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            found = [parse(texts, shared.value) for texts in by_length(part.column(text_col).to_pylist())]
            score, known = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            yield replace_columns(part, {"lang_pred": pa.array([n for f in found for n in f[0]], pa.string()), "score": pa.array(score), "recognised": pa.array(known)})

    return map_batches(docs, run, replaced_schema(docs, fields))
