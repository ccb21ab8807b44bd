"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the eight bytes before a white-space byte says so, so equal passages give equal
chunks wherever they stand.  Chunks that occur often in the corpus are encoded once, in a shared table; the rest once
per worker, in a bounded memory.

Joins are repaired until they agree exactly with encoding the whole: a join is sound if white space follows a character
that isn't white space, for there byte-level BPE starts a new piece whatever comes before.  At any other join (inside a
run of white space, or after a character that may be white space beyond ASCII) the two chunks are joined and encoded
again as one, and the next join is looked at, until all joins of the text are sound.

The shared table holds the ``SHARED`` chunks that save most bytes, so its broadcast has a fixed bound; counts cover
every chunk of every text, and only hashes and numbers are shuffled.  It changes the work, never the ids.

A chunk is encoded by the merges of the vocabulary in a faster encoder where it holds only characters up to U+017F and no
special token (white space and letters are the same for every Unicode version there), else by the tokenizers library.

Decoding joins the bytes of the ids.  Defined cases: null text is an empty text with no ids; null doc_id and repeated
rows pass through; texts that hold a special token's string get its id, as the tokenizers library does; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import portions, small_batches, table, trim

WINDOW, MASK = 8, np.uint32(63)
SHARED = 16_384
SHARED_BYTES = 6 << 20
MEMORY_BYTES = 8 << 20
#: Bytes of text whose ids and decoded texts are held at a time.
PORTION = 1 << 20
#: Rows an Arrow batch; Spark's 10,000 whole texts are tens of MB a task, in the JVM and again in its Python worker.
BATCH_ROWS = 1024
_SPACES = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear" + bytes([i])).digest()[:4] for i in range(256)), np.uint32)
#: Fixed value: the piece pattern of byte-level BPE vocabularies of this family.
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u017f]").search
_CODECS: dict[str, "Codec"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sound(data: bytes, at: int) -> bool:
    """Is a join before the white-space byte ``at`` a piece boundary whatever stands around it?"""
    c = data[at - 1]
    return 0x21 <= c <= 0x7E or (c >= 0x80 and at > 1 and data[at - 2] == 0xC3)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks, joins repaired: their encodings joined are the encoding of the whole."""
    if len(data) < 64:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_SPACES[b])
    at = at[at >= WINDOW]
    h = np.zeros(len(at), np.uint32)
    for k in range(WINDOW):
        h = (h << np.uint32(1)) + _GEAR[b[at - WINDOW + k]]
    h ^= h >> np.uint32(15)
    out, start = [], 0
    for p in at[(h & MASK) == 0].tolist():
        if sound(data, p):  # else the chunks on both sides stay one
            out.append(data[start:p])
            start = p
    out.append(data[start:])
    return out


def _bytes_of_units() -> dict[str, int]:
    """The byte each printable unit of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    units = {chr(c): c for c in plain}
    for i, c in enumerate(c for c in range(256) if c not in plain):
        units[chr(0x100 + i)] = c
    return units


class Codec:
    """Encoder of the given vocabulary with a bounded memory of chunks: hash -> (ids as bytes, decoded bytes)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        import tiktoken

        units, special = _bytes_of_units(), {t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if token in special else bytes(units[c] for c in token)
        self.special = [t.encode() for t in special]
        ranks = {p: i for i, p in enumerate(self.pieces) if p and p not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[int, tuple[bytes, bytes]] = {}
        self.held = 0
        del vocab, ranks
        gc.collect()
        trim()  # what reading the vocabulary took is several times what stays

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def plain(self, text: str, data: bytes) -> bool:
        """Only characters up to U+017F and no special token: there all Unicode versions agree on letters, digits and spaces."""
        return not OTHER(text) and not any(s in data for s in self.special)

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        out: list = [None] * len(texts)
        rest = []
        for i, data in enumerate(texts):
            text = data.decode()
            if self.plain(text, data):
                out[i] = self.fast.encode_ordinary(text)
            else:
                rest.append((i, text))
        for (i, _), e in zip(rest, self.tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = e.ids
        return [(np.array(ids, "<u4").tobytes(), self.decode(ids)) for ids in out]

    def documents(self, texts: list[bytes], shared: dict[int, tuple[bytes, bytes]]):
        """(ids as bytes, decoded bytes) of each text; chunks seen before aren't encoded again."""
        for at in range(0, len(texts), 64):
            cut_up = [[(xxhash.xxh3_64_intdigest(c), c) for c in chunks(t)] for t in texts[at : at + 64]]
            new = {h: c for row in cut_up for h, c in row if h not in shared and h not in self.memory}
            found = dict(zip(new, self.encode(list(new.values())), strict=True))
            for row in cut_up:
                parts = [shared.get(h) or found.get(h) or self.memory[h] for h, _ in row]
                yield b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)
            self.held += sum(len(x) + len(y) for x, y in found.values())
            if self.held > MEMORY_BYTES:
                self.memory, self.held = {}, 0
            self.memory.update(found)


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def release() -> None:
    """Forget the vocabulary and what was encoded at the end of a task: all workers of the pool take turns, so each would hold them while idle."""
    _CODECS.clear()
    gc.collect()
    trim()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _count_chunks(batches):
    for b in batches:
        seen: dict[int, list[int]] = {}
        for t in b["text"].cast(pa.binary()):
            for c in chunks(t.as_py() or b""):
                row = seen.setdefault(_signed(xxhash.xxh3_64_intdigest(c)), [0, len(c)])
                row[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array([r[0] for r in seen.values()], pa.int64()), pa.array([r[1] for r in seen.values()], pa.int64())], ["h", "times", "size"])
    trim()


def shared_chunks(docs: DataFrame, path: str, limit: int = SHARED) -> dict[int, tuple[bytes, bytes]]:
    """The chunks whose reuse saves most bytes, each encoded once: hash -> (ids, decoded bytes)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    counts = texts.mapInArrow(_count_chunks, "h long, times long, size long").groupBy("h").agg(F.sum("times").alias("times"), F.max("size").alias("size"))
    top = counts.where("times > 1").orderBy(((F.col("times") - 1) * F.col("size")).desc(), "h").limit(limit).collect()
    chosen, room = [], SHARED_BYTES
    for r in top:
        if r["size"] <= room:
            chosen.append(r["h"])
            room -= r["size"]
    wanted = spark.sparkContext.broadcast(frozenset(chosen))

    def fetch(batches):
        given: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"].cast(pa.binary()):
                for c in chunks(t.as_py() or b""):
                    h = _signed(xxhash.xxh3_64_intdigest(c))
                    if h in wanted.value and h not in given:
                        given.add(h)
                        out.append((h, c))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["h", "chunk"])
        trim()

    def encode(batches):
        for b in batches:
            done = codec(path).encode(b["chunk"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([i for i, _ in done], pa.binary()), pa.array([d for _, d in done], pa.binary())], ["h", "ids", "decoded"])
        release()

    once = texts.mapInArrow(fetch, "h long, chunk binary").groupBy("h").agg(F.first("chunk").alias("chunk"))
    rows = once.mapInArrow(encode, "h long, ids binary, decoded binary").collect()
    return {r["h"] % (1 << 64): (bytes(r["ids"]), bytes(r["decoded"])) for r in rows}


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, with_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit) and decoded text (unless told, where ids are)."""
    with_decoded = with_ids if with_decoded is None else with_decoded
    path = path or default_vocabulary()
    small_batches(docs.sparkSession, BATCH_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_decoded

    def run(batches):
        c = codec(path)
        for b, texts in portions(batches, PORTION):
            done = []
            for ids, decoded in c.documents(texts, shared.value):
                text = decoded.decode("utf-8", "replace")
                done.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) + ((ids,) if with_ids else ()) + ((text,) if with_decoded else ()))
            cols = list(zip(*done, strict=True)) if done else [()] * (len(names) - 1)
            types = [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_ids + [pa.string()] * with_decoded
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, t) for x, t in zip(cols, types))], names)
        del c
        release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_decoded
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
