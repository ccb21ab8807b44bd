"""Language identification by cross-parsing entropy.

For each language a suffix automaton (all factors of a reference text) is built from labelled text.  A document is
cross-parsed against it: from each place the longest match is one phrase, the next phrase starts at the character that
broke it.  Phrases are normalised by the language's reference: a phrase costs log2 of its length, the bits that name a
place in it.  The language of the least cost wins.

Reference text is a bounded sample, at most ``REFERENCE_CHARS`` characters a language, from documents chosen by hash
among those whose crc32(doc_id) mod 5 is not 0.  Whole texts are scored.  Letters are lower-cased and runs of other
characters count as one space.

Every character of the reference texts has its own code; one that a language's reference lacks has no transition there.
The automata are sparse transition tables, whose rows lie over each other in one array, so their size goes with the
reference text and not with the number of letters.  A batch is parsed in lockstep: texts are cut into rows of ``STRIDE``
characters, all rows step together through one table, so the work is a few array operations per character whatever the
text lengths.  The count is that of the whole text's parse: a row is parsed as if a phrase began at its start, and then
again from the state in which the row before it really ended, until both parses are in the same state (after some
phrases), from where on they are one.  Portions of ``BATCH`` characters bound the memory; one longer text is one portion.
One scan, no shuffle; the reference text of some KB is broadcast and each worker builds its tables once.

Defined cases: null text or text without a letter is ``und`` with score 0; null or repeated doc_id is scored like any
other, null counting as crc32 of the empty text; with no labelled text every prediction is ``und``; ties go to the first
language by code point; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import table

REFERENCE_CHARS = 30_000
STRIDE = 256
BATCH = 2_000_000
FOLDS = 5
_TABLES: dict[str, tuple] = {}


def normalise(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of a sequence of codes from 1 on; code 0 has no transition.

    A state is the offset of its row, its own one; entry ``offset + code`` is a transition where ``owner`` names the offset.
    """

    def __init__(self, codes: list[int], alphabet: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        offsets = self._lay(nxt)
        size = max(offsets) + alphabet
        self.owner, self.to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for row, at in zip(nxt, offsets, strict=True):
            for c, j in row.items():
                self.owner[at + c], self.to[at + c] = at, offsets[j]
        self.root = offsets[0]
        self.start = np.full(alphabet, self.root, np.int32)
        for c, j in nxt[0].items():
            self.start[c] = offsets[j]

    @staticmethod
    def _lay(nxt: list[dict[int, int]]) -> list[int]:
        """An offset for each row, such that no two rows share an entry or an offset: the next fit, long rows first."""
        offsets, used, filled, last = [0] * len(nxt), set(), set(), {}
        for i in sorted(range(len(nxt)), key=lambda i: -len(nxt[i])):
            row = list(nxt[i])
            at = last.get(len(row), 0)
            while at in used or any(at + c in filled for c in row):
                at += 1
            offsets[i] = last[len(row)] = at
            used.add(at)
            filled.update(at + c for c in row)
        return offsets

    def phrases(self, grid: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Breaks in each row, one more in a text's first; rows are sorted by falling length, ``grid`` is column-major over rows.

        ``before``: the row that precedes each one in its text, -1 for a first row (all rows are, where it isn't given).
        """
        k = grid.shape[1]
        before = np.full(k, -1) if before is None else before
        path, broken = np.empty(grid.shape, np.int32), np.zeros(grid.shape, bool)
        state = np.full(k, self.root, np.int32)
        live = np.searchsorted(-lengths, -np.arange(len(grid)), "left")
        for step, c in enumerate(grid):
            n = live[step]
            if not n:
                break
            broken[step, :n], state[:n] = self._step(state[:n], c[:n])
            path[step] = state
        count = broken.sum(0)
        end, start = state, np.full(k, self.root, np.int32)
        todo = np.flatnonzero(before >= 0)
        while len(todo := todo[end[before[todo]] != start[todo]]):
            start[todo] = end[before[todo]]
            count[todo], end[todo] = self._again(todo, start[todo], grid, lengths, path, broken)
            todo = np.flatnonzero(before >= 0)
        return count + ((before < 0) & (lengths > 0))

    def _step(self, state, c):
        at = state + c
        broke = self.owner[at] != state
        return broke, np.where(broke, self.start[c], self.to[at])

    def _again(self, rows, state, grid, lengths, path, broken):
        """Breaks and last states of rows that start in the given states; their paths are set right as far as they differ."""
        active = np.arange(len(rows))
        for step in range(len(grid)):
            active = active[lengths[rows[active]] > step]
            if not len(active):
                break
            at = rows[active]
            broken[step, at], now = self._step(state[active], grid[step, at])
            state[active] = now
            same = path[step, at] == now
            path[step, at] = now
            active = active[~same]
        last = np.maximum(lengths[rows] - 1, 0)
        return broken[:, rows].sum(0), path[last, rows]


def phrase_cost(reference: str) -> float:
    """Bits that name a place in a reference."""
    return float(np.log2(len(reference) + 1))


def models(reference: dict[str, str]) -> tuple[list[str], np.ndarray, list[Automaton]]:
    """Languages, code of each code point (1 and up; 0 is in no reference), automata."""
    key = str(sorted((k, zlib.crc32(v.encode())) for k, v in reference.items()))
    if key not in _TABLES:
        langs = sorted(reference)
        letters = sorted(set().union(*reference.values()))
        codes = np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.int32)
        for i, c in enumerate(letters):
            codes[ord(c)] = i + 1
        automata = [Automaton([int(codes[ord(c)]) for c in reference[lang]], len(letters) + 1) for lang in langs]
        _TABLES.clear()
        _TABLES[key] = (langs, codes, automata)
    return _TABLES[key]


_FOLD = np.arange(0x110000, dtype=np.uint32)
_ALPHA = np.zeros(0x110000, bool)


def _fold_tables():
    """Lower case by code point where that is one code point, and which code points are letters."""
    if not _ALPHA[ord("a")]:
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            _ALPHA[i] = c.isalpha()
            if len(low := c.lower()) == 1:
                _FOLD[i] = ord(low)
    return _FOLD, _ALPHA


def encode(text: bytes, codes: np.ndarray) -> tuple[np.ndarray, bool]:
    """Codes of the normalised text, and whether it has a letter."""
    fold, alpha = _fold_tables()
    points = fold[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
    letter = alpha[points]
    if not letter.any():
        return np.empty(0, codes.dtype), False
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate([[False], letter[:-1]])  # one space after a word
    points = points[keep]
    return codes[points[:-1] if points[-1] == 32 else points], True


def count_phrases(coded: list[np.ndarray], automata: list[Automaton]) -> np.ndarray:
    """Phrases of each text (rows) against each automaton (columns)."""
    total = np.zeros((len(coded), len(automata)), np.int64)
    rows, owner, before = [], [], []
    for i, c in enumerate(coded):
        for at in range(0, len(c), STRIDE):
            before.append(len(rows) - 1 if at else -1)
            rows.append(c[at : at + STRIDE])
            owner.append(i)
    if not rows:
        return total
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    grid = np.zeros((STRIDE, len(rows)), coded[0].dtype)
    for to, k in enumerate(order):
        grid[: lengths[k], to] = rows[k]
    before = np.array(before)[order]
    before = np.where(before >= 0, place[before], -1)
    for j, a in enumerate(automata):
        total[:, j] = np.bincount(np.array(owner)[order], a.phrases(grid, lengths[order], before), len(coded))
    return total


def predict(texts: list[bytes | None], reference: dict[str, str]) -> tuple[list[str], np.ndarray]:
    langs, codes, automata = models(reference)
    coded, lettered = [], np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        c, lettered[i] = encode(t or b"", codes)
        coded.append(c)
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs or not lettered.any():
        return names, score
    total = np.concatenate([count_phrases(coded[a:b], automata) for a, b in _portions([len(c) for c in coded])])
    cost = total * np.array([phrase_cost(reference[lang]) for lang in langs])
    best, least = cost.argmin(1), np.sort(cost, 1)
    second = least[:, 1] if len(langs) > 1 else np.array([max(len(c), 1) for c in coded]) * phrase_cost(reference[langs[0]])
    for i in np.flatnonzero(lettered):
        names[i] = langs[best[i]]
        score[i] = min(1.0, max(0.0, 1 - least[i, 0] / max(second[i], 1)))
    return names, score


def _portions(sizes: list[int]):
    """(from, to) of neighbouring texts that hold at most ``BATCH`` characters together, or one text."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > BATCH and i > start:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(sizes)


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def reference_texts(docs: DataFrame, chars: int = REFERENCE_CHARS) -> dict[str, str]:
    """At most ``chars`` characters of labelled text a language, from documents outside the held-out fold."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: (r["n"], r["chars"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if not counts:
        return {}
    # Per language a hash threshold that lets through about four times the characters wanted; all rows where it has fewer.
    limit = F.lit(0)
    for lang, (n, total) in counts.items():
        share = min(1.0, 4 * chars / max(total, 1) + 40 / n)
        limit = F.when(F.col("lang") == lang, F.lit(min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1))).otherwise(limit)
    rows = usable.where(F.col("h") <= limit).select("lang", "h", F.substring("text", 1, chars).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(out.setdefault(r["lang"], "")) < chars:
            out[r["lang"]] = (out[r["lang"]] + " " + normalise(r["text"]))[: chars + 1]
    return {k: v.strip() for k, v in out.items() if v.strip()}


def identify(docs: DataFrame, reference: dict[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(reference)

    def run(batches):
        for b in batches:
            texts, names, scores = b["text"].cast(pa.binary()), [], []
            for at in range(0, b.num_rows, 1000):
                n, s = predict(texts.slice(at, 1000).to_pylist(), shared.value)
                names += n
                scores += s.tolist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, reference_texts(docs))
