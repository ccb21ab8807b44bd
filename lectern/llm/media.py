"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text and media references in document order, each reference with the
caption of its own figure.  Media live in a table of their own in the shared folder, keyed by the SHA-256 of the payload:
one row per distinct payload (of rows equal in id and payload all are written, and count once when read).  A digest join
resolves the references; positions and captions stay with them.

The stored form is 8-bit mono PCM in a WAV container (sample = byte), lossless.  Features are computed from the bytes that
are read back from the table.  Payloads never cross a shuffle: documents whose payload another one writes are found on
(id, digest) alone and left out by a broadcast of these pairs below a checked size, by a join beyond it.  References to one
payload are the side of the digest join that adaptive execution can split; text items join on keys of their own.

Defined cases: null text is an empty text, whose payload is 64 zero bytes; null html has no items; null id and repeated
rows pass through; ties don't occur, as equal digests have equal payloads; a caption outside a figure is text, of several
in a figure the last with words counts, a figure within a figure keeps its own; a reference without a stored payload
resolves to nulls; very long texts are single rows, taken one at a time; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, shared_path, table, utf8

PAD = 64
#: Pairs (id, digest) up to which a list of them is broadcast (about 80 bytes each).
BROADCAST_PAIRS = 100_000
RATE = 8000
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_STORED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % PAD or (0 if data else PAD))


def padded(text):
    """Column: UTF-8 bytes of the text with zero bytes up to a positive multiple of 64."""
    data = utf8(text)
    n = F.octet_length(data)
    zeros = F.when(n == 0, PAD).otherwise(F.pmod(-n, F.lit(PAD)))
    return F.concat(data, F.repeat(F.lit("\x00"), zeros.cast("int")).cast("binary"))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def features(samples: np.ndarray) -> str:
    """Peak, sum, energy about the midpoint, midpoint crossings and distinct levels of 8-bit samples, all in integers."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings};levels={int(np.count_nonzero(np.bincount(samples, minlength=256)))}"


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.skip, self.caption = [], [], 0, None
        self.figures = []  # open figures, each with its media and its caption

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self):
        if self.caption is not None:
            self.figures[-1]["caption"] = " ".join("".join(self.caption).split()) or self.figures[-1]["caption"]
            self.caption = None

    def end_figure(self):
        self.end_caption()
        figure = self.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            a = dict(attrs)
            if ref := a.get("src"):
                item = {"pos": len(self.items), "kind": "media", "text": None, "ref": ref, "caption": a.get("alt") or None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["media"].append(item)
        elif tag == "figure":
            self.flush()
            self.end_caption()
            self.figures.append({"media": [], "caption": None})
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.end_caption()
                self.caption = []
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "blockquote", "article", "section", "td", "tr", "table", "pre"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure":
            self.flush()
            if self.figures:
                self.end_figure()
        elif tag not in ("b", "i", "em", "strong", "span", "a", "code"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_items(html: str | None) -> list[dict]:
    """Ordered text and media-reference structs of a page."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    while p.figures:
        p.end_figure()
    return p.items


def _parse(batches):
    for b in batches:
        kind = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([parse_items(h) for h in b["html"].to_pylist()], pa.list_(kind))], ["id", "items"])


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, pos, kind, text, ref, caption: one row per item, in document order by pos."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(_parse, f"id {rows.schema['id'].dataType.simpleString()}, items array<{ITEM}>")
    return rows.select(F.col("id").alias(id_col), F.explode("items").alias("item")).select(id_col, "item.*")


def _store(batches):
    for b in batches:
        for i in range(b.num_rows):  # one payload at a time: a batch's copies together could be large
            payload = b["payload"][i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(payload).hexdigest()]), pa.array([to_wav(payload)], pa.binary())], ["digest", "media"])


def _features(batches):
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for digest, stored in zip(b["digest"], b["media"], strict=True):
            media = stored.as_py()
            back = from_wav(media)
            rows.append((digest.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _STORED.split(", ")])


def store(payloads: DataFrame) -> DataFrame:
    """digest, media: the stored form of a column ``payload``."""
    return payloads.select("payload").mapInArrow(_store, "digest string, media binary")


def media_table(docs: DataFrame, id_col: str, payload) -> DataFrame:
    """The media of ``docs``, written to the shared folder, one row per distinct payload, and read back."""
    spark, digest = docs.sparkSession, F.sha2(payload, 256)
    pairs = docs.select(F.col(id_col).alias("id"), digest.alias("digest"))
    shared = pairs.groupBy("digest").agg(F.min("id").alias("writer"), F.count("*").alias("n")).where("n > 1").select("digest", "writer")
    # The smallest id of a payload writes it; if all its ids are null, every one does.
    others = pairs.join(shared, "digest").where("writer is not null and not (id <=> writer)")
    others = cut(others.select(F.col("id").alias("other_id"), F.col("digest").alias("other_digest")).distinct(), "media-copies")
    few = others.count() <= BROADCAST_PAIRS
    rows = docs.select(F.col(id_col).alias("id"), payload.alias("payload"))
    rows = rows.join(F.broadcast(others) if few else others, F.col("id").eqNullSafe(F.col("other_id")) & (F.sha2("payload", 256) == F.col("other_digest")), "left_anti")
    path = shared_path(spark, "media")
    store(rows).write.option("compression", "zstd").parquet(path)
    return spark.read.schema("digest string, media binary").parquet(path)


def described(media: DataFrame) -> DataFrame:
    """One row per distinct digest, with what is read back from the stored form."""
    rows = media.mapInArrow(_features, _STORED)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns if c != "digest"))


def resolve(sequence: DataFrame, media: DataFrame) -> DataFrame:
    """Digest join: every media item of the sequence with its payload's columns, text items with nulls."""
    digest = F.when(F.col("kind") == "media", F.nullif(F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1), F.lit("")))
    # Items without a digest get a key that matches nothing, each its own, so they don't meet in one task.
    alone = F.concat(F.lit("none:"), F.hex(F.xxhash64(*sequence.columns)))
    rows = sequence.withColumn("__digest", digest).withColumn("__key", F.coalesce("__digest", alone))
    joined = rows.join(media.withColumnRenamed("digest", "__key"), "__key", "left")
    return joined.drop("__key").withColumnRenamed("__digest", "digest")


def op1_media_sequences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    payload = padded(F.col("text"))
    stored = described(media_table(docs, "doc_id", payload))
    n = F.octet_length(utf8(F.col("text"))).cast("long")
    caption = F.concat(n.cast("string"), F.lit(" bytes"))
    html = F.concat(F.lit('<article><p>before</p><figure><img src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>after</p></article>"))
    pages = docs.select(F.struct("doc_id", n.alias("n_bytes")).alias("id"), html.alias("html"))
    items = resolve(interleave(pages, "id", "html"), stored).where("kind = 'media'")
    return items.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
