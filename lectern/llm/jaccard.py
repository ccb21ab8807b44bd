"""N-gram Jaccard join, exact: documents whose sets of 5-word shingles have Jaccard similarity 0.75 or more.

The Jaccard distance is a metric, but most documents lie at distance 1 from all others, where any pivot is as near as
any other and windows of the triangle inequality keep everything.  So the regions are found in this order:

1. Equal sets are one node (``sid``), so exact copies cost nothing further.
2. Each set names the regions it may have partners in: its prefix, the first ``n - ceil(0.75 n) + 1`` shingles of an order
   of all shingles.  Two linked sets share a prefix shingle, so this replication is lossless; a region is a run of sets
   that share one.  The order puts shingles of crowded buckets last (counts over all documents in a table of fixed size),
   which keeps regions small.  The order only decides the work; any order gives the same links.
3. A region is its list of members, one row a member; equal lists are one region.  Pairs are never rows here.  A member of
   a small region goes if no other one passes the size bound and the positional bound with it: two linked sets that share
   this shingle first share at most what is left of either, and that is 3/7 of both sizes or more.
4. Regions of up to ``REGION`` sets are joined within one task, where each member carries a short parity bitmap (its
   Hamming distance never exceeds the symmetric difference, so no link is lost).  Only the edges of a spanning forest of
   the pairs that pass size bound and bitmap come out, at most one a member, and are measured exactly.  A region all of whose
   edges are links, or join what is joined already, is settled: any other pair of it that could link is in one component.
   The few other regions give all their passing pairs between different components.
5. In a larger region the smallest sid is the pivot; regions with the same pivot are its cell.  Each member's exact
   distance to the pivot is found, one pair per member; members within 0.25 of it are one component.  Recursion: what lies
   outside a cell's largest component is tried against a few more pivots of that component a round, while rounds still
   absorb much.  The rest meets, block by block, the blocks inside the triangle window ``|d(x, p) - d(y, p)| <= 0.25``.
6. Every link is decided by the exact intersection of two sets of 64-bit shingle hashes.  Sets are told apart by 128 bits:
   a ``sid`` is the low half of the hash of a set, and of its high half where two sets share the low one.

Defined cases: null or wordless text has an empty set, links with nothing and is its own component; a text of fewer than
five words is one shingle; a null doc_id takes part, and its component's id is the smallest non-null one (null if
there is none); repeated rows are equal sets; ties don't occur, as a component is named by its smallest id; very long
texts are read whole, in portions, and carry bitmaps of at most ``SHORT_BITS`` through regions; an empty table gives an
empty result; other columns are ignored, or kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WordHashes, cut, mix64, portions, shingle_set, table, trim
from lectern.llm.components import components

WIDTH = 5
#: Sets in a region that is joined without a pivot.
REGION = 64
SKETCH_BITS = 21
#: Buckets of the bitmaps that go through regions; the full ones of longer sets are looked up by pair.
SHORT_BITS = 4096
#: Pivots a round; members of a block; rings of the distance to a pivot.
PIVOTS, BLOCK, RINGS = 8, 256, 16
#: Partners of a set that are compared with it in one place.
PARTNERS = 256
#: Document ids up to which a list of them is broadcast (8 bytes each).
BROADCAST_IDS = 200_000
_META = "kind int, doc_id long, th long, n int, sid long, high long, short binary, bits binary"


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Both halves of the hash of a set."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return _signed(x & ((1 << 64) - 1)), _signed(x >> 64)


def set_id(s: np.ndarray, shared: frozenset = frozenset()) -> int:
    """The low half; the high one where different sets share the low one."""
    low, high = set_ids(s)
    return high if low in shared else low


def parity_bits(s: np.ndarray) -> bytes:
    """One bit per bucket of the low hash bits: the parity of its shingles; a power of two of at least 2n buckets."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """False only if the symmetric difference is surely too large: at most (na + nb) / 7 for a link."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a) * 8
    while size > len(b) * 8:
        size >>= 1
        x = (x & ((1 << size) - 1)) ^ (x >> size)
    return 7 * (x ^ int.from_bytes(b, "little")).bit_count() <= na + nb


def shorten(bits: bytes) -> bytes:
    """A bitmap folded to at most ``SHORT_BITS`` buckets."""
    while len(bits) * 8 > SHORT_BITS:
        x = np.frombuffer(bits, np.uint8)
        bits = (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()
    return bits


def linked(na: int, nb: int, common: int) -> bool:
    return 100 * common >= 75 * (na + nb - common)


def _describe(batches):
    """Per document its size, sid and bitmap; last, the task's table of bucket counts."""
    memory, table_ = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
    shift = np.uint64(64 - SKETCH_BITS)
    names = [f.split()[0] for f in _META.split(", ")]
    for b, texts in portions(batches):
        ns, lows, highs, shorts, fulls, hashes = [], [], [], [], [], []
        for t in texts:
            s = shingle_set(t, memory, WIDTH)
            low, high = set_ids(s) if len(s) else (0, 0)
            full = parity_bits(s) if len(s) else b""
            ns.append(len(s))
            lows.append(low)
            highs.append(high)
            shorts.append(shorten(full))
            fulls.append(full if len(full) * 8 > SHORT_BITS else None)
            hashes.append(s)
        if ns:
            at, k = np.unique((np.concatenate(hashes) >> shift).astype(np.uint32), return_counts=True)
            table_[at] += k.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(ns), pa.int32()), b["doc_id"], b["th"], pa.array(ns, pa.int32()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(shorts, pa.binary()), pa.array(fulls, pa.binary())], names)
    if table_.any():
        blob = zlib.compress(np.minimum(table_, 0xFF).astype(np.uint8).tobytes(), 1)
        none = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), none, none, pa.array([0], pa.int32()), none, none, pa.array([blob], pa.binary()), pa.array([None], pa.binary())], names)
    trim()


def _add_tables(last: bool):
    """Sum of the tables of a partition; of the last sum only the bits of the buckets that stand out."""

    def run(batches):
        total = None
        for b in batches:
            for blob in b["short"]:
                raw = zlib.decompress(blob.as_buffer())
                part = np.frombuffer(raw, np.uint8 if len(raw) == 1 << SKETCH_BITS else np.uint32)
                total = part.astype(np.uint32) if total is None else total + part
        if total is not None:
            mean = float(np.median(total))
            out = np.packbits(total > mean + 6 * mean**0.5 + 32).tobytes() if last else zlib.compress(total.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["short"])

    return run


def crowded_buckets(meta: DataFrame) -> bytes:
    """Bits of the buckets whose count stands out.  The table has a fixed size; parts are added on executors, 16 at a time."""
    parts = meta.where("kind = 1").select("short")
    n = parts.count()
    while n > 16:
        n = -(-n // 16)
        parts = parts.repartition(n).mapInArrow(_add_tables(False), "short binary")
    rows = parts.repartition(1).mapInArrow(_add_tables(True), "short binary").collect()
    return bytes(rows[0]["short"]) if rows else bytes(1 << (SKETCH_BITS - 3))


def prefix(s: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    hot = crowded[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    k = prefix_length(len(s))
    cold = s[~hot]
    return cold[:k] if len(cold) >= k else np.concatenate([cold, s[hot][: k - len(cold)]])


def _regions_of(docs: DataFrame, crowded: bytes, shared: frozenset) -> DataFrame:
    """h, sid, size: a row per prefix shingle of each set; size is 64 times n plus the shingle's place in the order of the set in 64ths of n, rounded down."""
    packed = docs.sparkSession.sparkContext.broadcast(crowded)

    def run(batches):
        memory, order = WordHashes(), np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        for _, texts in portions(batches):
            seen: set[int] = set()
            hs, sids, ns = [np.empty(0, np.uint64)], [], []
            for t in texts:
                s = shingle_set(t, memory, WIDTH)
                if len(s) and (sid := set_id(s, shared)) not in seen:
                    seen.add(sid)
                    hs.append(prefix(s, order))
                    sids.append(sid)
                    ns.append(len(s))
            sizes = [len(h) for h in hs]
            place = np.concatenate([np.arange(k, dtype=np.int64) for k in sizes])
            n = np.repeat(np.array(ns, np.int64), sizes[1:])
            cols = [np.concatenate(hs).view(np.int64), np.repeat(np.array(sids, np.int64), sizes[1:]), 64 * n + 64 * place // np.maximum(n, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "sid", "size"])

    return docs.select("text").mapInArrow(run, "h long, sid long, size long")


_MEMBERS = "large boolean, rid long, sid long, n int"


class _Lists:
    """Member rows of regions, equal lists once, given out in bounded parts.  A region up to ``REGION`` is named by its list, a larger one by its pivot."""

    def __init__(self):
        self.parts, self.held = {False: [], True: []}, 0

    def small(self, sid, n, place, starts, k):
        """Regions of ``k`` rows each.  A member stays if another one passes the size and the positional bound with it."""
        for some in np.array_split(starts, -(-len(starts) * k * k // 4_000_000)):
            at = some[:, None] + np.arange(k)
            size, rest = n[at], n[at] - place[at]
            # If this is the first shingle that two sets share, they share no more than what is left of either.
            need = size[:, :, None] + size[:, None, :]
            pairs = 7 * np.minimum(rest[:, :, None], rest[:, None, :]) >= 3 * need
            pairs &= 7 * np.minimum(size[:, :, None], size[:, None, :]) >= 3 * need
            pairs[:, np.arange(k), np.arange(k)] = False
            stays = pairs.any(2)
            # The list's name: members that go count as none.
            rid = np.zeros(len(some), np.uint64)
            for j in range(k):
                rid = np.where(stays[:, j], mix64(rid * np.uint64(0x9E3779B97F4A7C15) + sid[at[:, j]].astype(np.uint64)), rid)
            rid, first = np.unique(rid.view(np.int64), return_index=True)
            stays, at = stays[first], at[first][stays[first]]
            self.add(False, np.repeat(rid, stays.sum(1)), sid[at], n[at])

    def large(self, pivot, sid, n):
        self.add(True, np.full(len(sid), pivot), sid, n)

    def add(self, kind, rid, sid, n):
        if len(rid):
            self.parts[kind].append(np.column_stack([rid, sid, n]))
            self.held += len(rid)

    def out(self, least: int = 0):
        if self.held <= least:
            return
        for kind, parts in self.parts.items():
            rows = np.unique(np.concatenate(parts), axis=0) if parts else np.empty((0, 3), np.int64)
            for at in range(0, len(rows), 50_000):
                r = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind)), pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(r[:, 2].astype(np.int32))], ["large", "rid", "sid", "n"])
        self.parts, self.held = {False: [], True: []}, 0


def _list_regions(batches):
    """Rows sorted by (h, sid) give the members of regions of two sets or more."""
    found, names = _Lists(), ("h", "sid", "size")
    keep = tuple(np.empty(0, np.int64) for _ in names)
    large = None  # (h, pivot) of a large region whose members are passing through

    def settle(h, sid, size):
        n, place = size >> 6, ((size >> 6) * (size & 63)) >> 6
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(h)]]))
        for k in np.unique(lengths[lengths > 1]).tolist():
            if k <= REGION:
                found.small(sid, n, place, starts[lengths == k], k)
            else:
                for at in starts[lengths == k].tolist():
                    found.large(sid[at], sid[at : at + k], n[at : at + k])

    for b in batches:
        rows = tuple(np.concatenate([old, b[c].to_numpy().astype(np.int64)]) for old, c in zip(keep, names, strict=True))
        h, sid = rows[:2]
        if not len(h):
            continue
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
        rows = tuple(c[new] for c in rows)
        h, sid, size = rows
        if large:
            k = int(np.searchsorted(h, large[0], "right"))
            found.large(large[1], sid[:k], size[:k] >> 6)
            if k == len(h):  # the last row may come again
                keep = tuple(c[-1:] for c in rows)
                yield from found.out(500_000)
                continue
            rows, large = tuple(c[k:] for c in rows), None
            h, sid, size = rows
        last = int(np.searchsorted(h, h[-1], "left"))
        if last:
            settle(*(c[:last] for c in rows))
        if len(h) - last > REGION:
            large = (int(h[-1]), int(sid[last]))
            found.large(large[1], sid[last:], size[last:] >> 6)
            last = len(h) - 1
        keep = tuple(c[last:] for c in rows)
        yield from found.out(500_000)
    if len(keep[0]) and not large:
        settle(*keep)
    yield from found.out()
    trim()


def _fold(bits: bytes) -> dict[int, int]:
    """A parity bitmap as integers of its own size and of half of it, by size in bits."""
    x, size, out = int.from_bytes(bits, "little"), len(bits) * 8, {}
    for _ in range(2):
        out[size] = x
        size >>= 1
        x = (x & ((1 << size) - 1)) ^ (x >> size)
    return out


class _Member:
    __slots__ = ("sid", "n", "folds", "root")

    def __init__(self, sid, n, bits, root=None):
        self.sid, self.n, self.folds, self.root = sid, n, _fold(bits), root

    def near(self, other) -> bool:
        """False only where the size bound or the bitmaps rule a link out."""
        n, m = self.n, other.n
        if 4 * n < 3 * m or 4 * m < 3 * n:
            return False
        k = min(max(self.folds), max(other.folds))
        return 7 * (self.folds[k] ^ other.folds[k]).bit_count() <= n + m


def _regions_in(batches, names):
    """(rid, members) of rows sorted by rid."""
    rid, held = None, []
    for b in batches:
        for r, *m in zip(b["rid"].to_pylist(), *(b[c].to_pylist() for c in names), strict=True):
            if r != rid and held:
                yield rid, held
                held = []
            rid = r
            held.append(_Member(*m))
    if held:
        yield rid, held


def spanning_forest(members: list[_Member]):
    """Edges that join all members which a chain of passing pairs joins."""
    left = list(members)
    while left:
        queue = [left.pop(0)]
        while queue and left:
            x, rest = queue.pop(), []
            for y in left:
                if x.near(y):
                    queue.append(y)
                    yield x, y
                else:
                    rest.append(y)
            left = rest


def _between_components(members: list[_Member]):
    for i, x in enumerate(members):
        for y in members[i + 1 :]:
            if x.root != y.root and x.near(y):
                yield x, y


_EDGES = "rid long, a long, b long, sure boolean"


def _edges_within(names, chosen, once: bool):
    """Edges of the regions; ``sure`` where the bitmaps compared were the full ones.  ``once``: a pair met again in a later region isn't repeated (rid is then that of one of them)."""

    def run(batches):
        out, seen = [], set()

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], ["rid", "a", "b", "sure"])

        for rid, members in _regions_in(batches, names):
            for x, y in chosen(members):
                pair = (x.sid, y.sid) if x.sid < y.sid else (y.sid, x.sid)
                if once:
                    if pair in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(pair)
                out.append((rid, *pair, 2 * max(x.n, y.n) <= SHORT_BITS))
            if len(out) > 50_000:
                yield flush()
                out = []
        yield flush()

    return run


def _filter_bits(batches):
    for b in batches:
        cols = [b[c].to_pylist() for c in ("na", "bits_a", "nb", "bits_b")]
        yield b.filter(pa.array([may_link(*r) for r in zip(*cols, strict=True)], pa.bool_())).select(["a", "b"])


_KEYED = "a long, salt int, member boolean, sid long, shingles binary"
_NO_SET = np.empty(0, np.uint64)


def _sets(shared: frozenset):
    """The sets of documents, each with the key it goes to."""

    def run(batches):
        memory = WordHashes()
        for b, texts in portions(batches):
            sids, sets = [], []
            for t in texts:
                s = shingle_set(t, memory, WIDTH)
                sids.append(set_id(s, shared))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b["a"], b["salt"], b["member"], pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["a", "salt", "member", "sid", "shingles"])

    return run


def _intersect(batches):
    """Rows sorted by (a, salt, member, sid): a set, then those it is compared with.  Two sets are in memory at a time."""
    key, first, last = None, _NO_SET, None
    for b in batches:
        out = []
        for a, salt, member, sid, x in zip(b["a"].to_pylist(), b["salt"].to_pylist(), b["member"].to_pylist(), b["sid"].to_pylist(), b["shingles"], strict=True):
            if not member:
                key, first, last = (a, salt), np.frombuffer(x.as_py(), np.uint64), None
            elif (a, salt) == key and sid != last:  # rows that repeat a document give its set again
                other, last = np.frombuffer(x.as_buffer(), np.uint64), sid
                out.append((a, sid, len(first), len(other), len(np.intersect1d(first, other, assume_unique=True))))
        cols = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb", "common"])


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among the ids; a short list is broadcast, so the rows stay where they are."""
    ids = cut(ids.distinct(), "keys")
    few = ids.count() <= BROADCAST_IDS
    ids = ids.toDF("__only")
    return df.join(F.broadcast(ids) if few else ids, df[key] == F.col("__only"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))


def _by_ids(docs: DataFrame, ids: DataFrame, how: str, *names: str) -> DataFrame:
    """Semi or anti join on columns; the list of keys is broadcast only below a checked size."""
    ids = cut(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select(*(F.col(c).alias(f"__only_{i}") for i, c in enumerate(names)))
    on = [docs[c].eqNullSafe(F.col(f"__only_{i}")) for i, c in enumerate(names)]
    return docs.join(F.broadcast(ids) if few else ids, on, how)


class _Corpus:
    def __init__(self, docs: DataFrame):
        docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        meta = cut(docs.mapInArrow(_describe, _META), "sets")
        self.docs, rows = docs, meta.where("kind = 0")
        twice = rows.where("n > 0").groupBy(F.col("sid").alias("low")).agg(F.min("high").alias("x"), F.max("high").alias("y")).where("x <> y")
        # Of N sets about N * N / 2 ** 65 share a low half: a handful at most.
        self.shared = frozenset(r["low"] for r in twice.select("low").collect())
        if self.shared:
            rows = rows.withColumn("sid", F.when(F.col("sid").isin(*self.shared), F.col("high")).otherwise(F.col("sid")))
        self.all = rows.select("doc_id", "th", "n", "sid")
        self.meta = rows.where("n > 0").select("doc_id", "th", "n", "sid", "short", F.coalesce("bits", "short").alias("bits"))
        self.crowded = crowded_buckets(meta)
        self.nodes = self.meta.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "th")).alias("one"))

    def regions(self) -> DataFrame:
        """large, rid, sid, n: the members of each region."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = _regions_of(self.docs, self.crowded, self.shared).repartition(parts, "h").sortWithinPartitions("h", "sid")
        return cut(rows.mapInArrow(_list_regions, _MEMBERS).distinct(), "regions")

    def edges(self, members: DataFrame, chosen, once: bool = False) -> DataFrame:
        """rid, a, b, sure of what ``chosen`` takes of the pairs of each small region; ``once``: a pair mostly once, of a few members."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        meta = _only(self.meta, "sid", members.select("sid")) if once else self.meta
        short = meta.groupBy("sid").agg(F.first("short").alias("short"))
        names = ["sid", "n", "short"] + ["root"] * ("root" in members.columns)
        rows = members.join(short, "sid").select("rid", *names).repartition(parts, "rid").sortWithinPartitions("rid", "sid")
        return rows.mapInArrow(_edges_within(names, chosen, once), _EDGES)

    def passing(self, edges: DataFrame) -> DataFrame:
        """Distinct (a, b), those compared by short bitmaps once more by the full ones."""
        edges = edges.select("a", "b", "sure").distinct()
        return edges.where("sure").select("a", "b").unionByName(self.near(edges.where("not sure").select("a", "b")))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the bitmaps don't rule out.  ``pairs``: a, b distinct."""
        pairs = cut(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return pairs
        bits = _only(self.meta, "sid", _ends(pairs)).groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
        one = bits.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        two = bits.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(_filter_bits, "a long, b long")

    def measure(self, pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, common: exact intersections of the sets of distinct pairs.

        Sets are made from one document of each node and go straight to the pair's key, in one shuffle.  The key is a; one
        with many partners is split by salt, and its own set goes to each part.
        """
        pairs = cut(pairs.select("a", "b"), "pairs")
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("r"))
        own = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("a").alias("sid"))
        others = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("r")).cast("int").alias("salt"), F.lit(True).alias("member"), F.col("b").alias("sid"))
        wanted = cut(self.nodes.join(own.unionByName(others), "sid").select("one.doc_id", "one.th", "a", "salt", "member"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        wanted = wanted.withColumnRenamed("doc_id", "__id").withColumnRenamed("th", "__th")
        rows = self.docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
        sets = rows.select("a", "salt", "member", "text").mapInArrow(_sets(self.shared), _KEYED)
        sets = sets.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "member", "sid")
        return sets.mapInArrow(_intersect, "a long, b long, na long, nb long, common long")


IS_LINK = "100 * common >= 75 * (na + nb - common)"


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, sid, root, component_id, one row per row of ``docs``."""
    c = _Corpus(docs)
    regions = c.regions()
    small = regions.where("not large").select("rid", "sid", "n")
    # Large regions with the same pivot are one cell: a pair that shares a region shares the cell.
    cells = regions.where("large").select(F.col("rid").alias("pivot"), "sid", "n")
    stars = cells.where("pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()

    forest = cut(c.edges(small, spanning_forest), "forest")
    tries = cut(c.passing(forest).unionByName(stars).distinct(), "tries")
    measured = cut(c.measure(tries), "measured")
    roots = components(measured.where(IS_LINK).select("a", "b"))

    # Regions with an edge that joined nothing: their other pairs between components.
    open_ = cut(_rooted(forest, roots).where("root_a <> root_b").select("rid").distinct(), "open")
    if not open_.isEmpty():
        members = small.join(open_, "rid", "left_semi").join(roots, F.col("sid") == F.col("node"), "left")
        members = cut(members.select("rid", "sid", "n", F.coalesce("root", "sid").alias("root")), "members")
        rest = cut(c.passing(cut(c.edges(members, _between_components, once=True), "between")), "rest")
        links = c.measure(rest).where(IS_LINK).select("a", "b")
        roots = components(links.unionByName(_edges(roots)))
    if not cells.isEmpty():
        roots, mixed = _absorb(c, cells, roots)
        if mixed is not None:
            roots = components(_windows(c, mixed, measured).unionByName(_edges(roots)))

    label = c.nodes.join(roots, c.nodes["sid"] == roots["node"], "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    least = label.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("least"))
    label = label.join(least, "root", "left").select("sid", "root", F.coalesce("least", "doc_id").alias("component_id"))
    return c.all.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(label, "sid", "left")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``."""
    return labelled(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b"))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _absorb(c: _Corpus, cells: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Shrink what lies outside each cell's largest component, against a few pivots of that component a round.

    Gives the components and, if any cell still has several, its members: pivot, sid, n, root, top (its largest's root).
    """
    turn, last = 0, None
    while True:
        spread = cells.join(roots, cells["sid"] == roots["node"], "left").select("pivot", "sid", "n", F.coalesce("root", "sid").alias("root"))
        counts = spread.groupBy("pivot", "root").agg(F.count("*").alias("k")).groupBy("pivot").agg(F.max(F.struct("k", "root")).alias("t"), F.sum("k").alias("total"))
        mixed = counts.where("t.k < total").select("pivot", F.col("t.root").alias("top"), (F.col("total") - F.col("t.k")).alias("rest"), "total")
        spread = cut(spread.join(mixed, "pivot"), "members")
        work = spread.agg(F.coalesce(F.sum(F.when(F.col("root") != F.col("top"), F.col("total"))), F.lit(0)).alias("pairs"), F.count("*").alias("rows")).first()
        if not work["rows"]:
            return roots, None
        # Rounds end when the last one absorbed little: what is left is far from the largest components.
        if last is not None and work["pairs"] > 0.8 * last:
            return roots, spread
        draw = F.xxhash64("sid", F.lit(turn))
        seats = spread.where("root = top").groupBy("pivot", F.pmod(draw, F.lit(PIVOTS)).alias("seat")).agg(F.min(F.struct(draw.alias("draw"), "sid", "n")).alias("q"))
        seats = seats.select("pivot", F.col("q.sid").alias("q"), F.col("q.n").alias("qn"))
        tries = spread.where("root <> top").join(seats, "pivot").where("4 * n >= 3 * qn and 4 * qn >= 3 * n")
        tries = tries.select(F.least("sid", "q").alias("a"), F.greatest("sid", "q").alias("b")).distinct()
        links = c.measure(c.near(tries)).where(IS_LINK).select("a", "b")
        roots = components(links.unionByName(_edges(roots)))
        turn, last = turn + 1, work["pairs"]


def _compare_blocks(batches):
    """a, b of the block pairs' members that the size bound, the triangle window and the bitmaps leave."""
    for b in batches:
        for at in range(b.num_rows):
            top, same = b["top"][at].as_py(), b["same"][at].as_py()
            xs, ys = b["xs"][at].as_py(), b["ys"][at].as_py()
            ys = sorted(((y["n"], y["sid"], y["root"], y["d"], _fold(y["bits"])) for y in ys), key=lambda y: y[0])
            sizes = np.array([y[0] for y in ys])
            out = []
            for x in xs:
                n, sid, root, d, fx = x["n"], x["sid"], x["root"], x["d"], _fold(x["bits"])
                for m, sid2, root2, d2, fy in ys[np.searchsorted(4 * sizes, 3 * n) : np.searchsorted(3 * sizes, 4 * n, "right")]:
                    # Of two members outside the largest component one order is enough.
                    if root2 == root or (root2 != top and same and sid >= sid2) or abs(d - d2) > 0.25 + 1e-9:
                        continue
                    k = min(max(fx), max(fy))
                    if 7 * (fx[k] ^ fy[k]).bit_count() <= n + m:
                        out.append((min(sid, sid2), max(sid, sid2)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _windows(c: _Corpus, members: DataFrame, measured: DataFrame) -> DataFrame:
    """Links between the components of a pivot's cell, whose pairs must lie in the triangle window about the pivot.

    Members are gathered in blocks of about ``BLOCK`` by their distance to the pivot.  Blocks of members outside the
    cell's largest component meet the blocks whose distances are in reach; a task holds one pair of blocks at a time, and
    only pairs that pass the bitmaps become rows.
    """
    dist = measured.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    members = members.join(dist, ["pivot", "sid"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    bits = _only(c.meta, "sid", members.select("sid")).groupBy("sid").agg(F.first("bits").alias("bits"))
    member = F.struct("sid", F.col("n").cast("int").alias("n"), "root", "d", "bits")
    ring = F.floor(F.col("d") * RINGS).cast("int")
    seat = F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK)))
    placed = members.join(bits, "sid").select("pivot", "top", "root", ring.alias("ring"), seat.alias("seat"), member.alias("m"))

    def blocks(rows, name):
        return rows.groupBy("pivot", "top", "ring", "seat").agg(F.collect_list("m").alias(name))

    placed = cut(placed, "placed")
    xs, minor, major = blocks(placed.where("root <> top"), "xs"), blocks(placed.where("root <> top"), "ys"), blocks(placed.where("root = top"), "ys")
    ys = minor.withColumn("same", F.lit(True)).unionByName(major.withColumn("same", F.lit(False)))
    ys = ys.select("pivot", F.col("ring").alias("ring_y"), "ys", "same")
    pairs = xs.select("pivot", "top", "ring", "xs").join(ys, "pivot").where(F.abs(F.col("ring") - F.col("ring_y")) <= RINGS // 4 + 1)
    near = pairs.select("top", "same", "xs", "ys").mapInArrow(_compare_blocks, "a long, b long")
    return c.measure(near.distinct()).where(IS_LINK).select("a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), then of the smallest text hash; all columns.

    Rows are told apart by (doc_id, text), so a null or reused doc_id hides none; of rows equal in both one stays.
    Documents with an empty set are in no group and all stay.
    """
    rows = cut(labelled(docs).where("n > 0").select("root", "doc_id", "th"), "labels")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    groups = rows.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("k")).where("k > 1").select("root", "best")
    doubles = rows.join(groups, "root")
    losers = doubles.where(~rank.eqNullSafe(F.col("best"))).select("doc_id", "th").distinct()
    names = docs.columns
    keyed = docs.withColumn("__row_th", F.xxhash64("text")).withColumn("__row_id", F.col("doc_id"))
    left = _by_ids(keyed, losers.select(F.col("doc_id").alias("__row_id"), F.col("th").alias("__row_th")), "left_anti", "__row_id", "__row_th")
    # Rows that repeat (doc_id, text): one of each stays.
    again = cut(doubles.groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("__row_id"), F.col("th").alias("__row_th")), "again")
    if again.isEmpty():
        return left.select(*names)
    twice = _by_ids(left, again, "left_semi", "__row_id", "__row_th")
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    one = twice.withColumn("__row_n", F.row_number().over(Window.partitionBy("__row_id", "__row_th").orderBy(whole))).where("__row_n = 1")
    return _by_ids(left, again, "left_anti", "__row_id", "__row_th").select(*names).unionByName(one.select(*names))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
