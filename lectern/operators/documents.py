"""Whole documents: responses and page geometry become documents with blocks or an error, then speech, chunks, audio rows.

An error is data: a document that can't be used keeps its row with (error, code, message, hint) and has no blocks, so one
bad page never ends a job.
"""

from __future__ import annotations

import io
import wave
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions import values as V
from lectern.operators import blocks as B
from lectern.operators import output as O
from lectern.operators import speech as S
from lectern.sources import landing, pdf, web

#: Kinds of failure and their exit codes (9 is retired).
CODES = {
    "general": 1, "usage": 2, "source": 3, "fetch": 4, "paywall": 5, "extraction": 6, "no_text_layer": 7, "config": 8,
    "synthesis": 10, "dependency": 11, "accent": 12, "model": 13,
}
#: Words of the least article, characters of the least text layer (in all, and a page).
MIN_ARTICLE_WORDS, MIN_CHARS_TOTAL, MIN_CHARS_PER_PAGE = 25, 100, 20
_HINTS = {
    "paywall": "Save the page as HTML where you are signed in, and read the file.",
    "extraction": "It may be a listing, a video or a page made by scripts: save it as HTML from a browser and read the file.",
    "no_text_layer": "It is probably a scan: run it through OCR first.",
    "fetch": "Check the address, or save the page as HTML and read the file.",
}


def error_code(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[kind]


def hint(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in _HINTS.items() for x in kv))[kind]


def failed(kind: Column, message: Column) -> Column:
    """struct(error, code, message, hint); nulls where ``kind`` is null."""
    return F.struct(kind.alias("error"), error_code(kind).alias("code"), F.when(kind.isNotNull(), message).alias("message"), hint(kind).alias("hint"))


# --- extraction --------------------------------------------------------------------------------------------------------
def route(responses: DataFrame) -> DataFrame:
    """``responses`` (doc_id, url, status, content_type, body) with kind: html, pdf or null for a refusal.  Content beats the address."""
    good = F.coalesce(F.col("status"), F.lit(200)).between(200, 299) & F.col("body").isNotNull()
    return responses.withColumn("kind", F.when(good, F.when(landing.is_pdf(F.col("content_type"), F.col("body")), "pdf").otherwise("html")))


def from_html(pages: DataFrame) -> DataFrame:
    """doc_id, url, title, words, n_blocks, blocks (array in order), error, code, message, hint from (doc_id, url, html); one parse a page.

    Under ``MIN_ARTICLE_WORDS`` words a page is gated if it carries paywall marks, else has no article.
    """
    rows = web.parsed(pages.select("doc_id", "url", "html"))
    words = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + T.words(b["text"]))
    rows = rows.withColumn("words", words).withColumn("marks", web.paywall_markers(F.coalesce("html", F.lit(""))))
    kind = F.when(F.col("words") >= MIN_ARTICLE_WORDS, None).when(F.size("marks") > 0, "paywall").otherwise("extraction")
    where = F.coalesce("url", F.lit("this page"))
    message = F.when(kind == "paywall", F.concat(where, F.lit(" is gated: "), F.col("words").cast("string"), F.lit(" words of text, "), F.get("marks", F.lit(0)))).otherwise(F.concat(F.lit("no article text in "), where))
    title = F.coalesce(web.strip_site_suffix(F.col("title"), F.coalesce("url", F.lit(""))), F.col("title"))
    rows = rows.withColumn("failed", failed(kind, message)).withColumn("title", title)
    return rows.select("doc_id", "url", "title", "words", F.size("blocks").cast("long").alias("n_blocks"), F.when(kind.isNull(), F.col("blocks")).alias("blocks"), "failed.*")


def blocks_of(documents: DataFrame) -> DataFrame:
    """Block rows of documents that have any."""
    rows = documents.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.*")
    return rows.withColumns({"page": F.lit(None).cast("int"), "position": F.lit(None).cast("double")})


def extract(responses: DataFrame) -> DataFrame:
    """HTML responses as documents, refusals and PDF bodies (whose bytes need a decoder: see ``from_spans``) as errors."""
    rows = route(responses)
    html = rows.where("kind = 'html'").withColumn("html", landing.decoded(F.col("body"), F.col("content_type")))
    read = from_html(html)
    kind = F.when(F.col("kind") == "pdf", "dependency").otherwise("fetch")
    said = F.when(F.col("kind") == "pdf", F.concat("url", F.lit(" is a PDF"))).otherwise(F.concat("url", F.lit(" "), web.explain_status(F.col("status"))))
    rest = rows.where("kind is null or kind = 'pdf'").withColumn("failed", failed(kind, said))
    zero = F.lit(0).cast("long")
    rest = rest.select("doc_id", "url", F.lit(None).cast("string").alias("title"), zero.alias("words"), zero.alias("n_blocks"), F.lit(None).cast(read.schema["blocks"].dataType).alias("blocks"), "failed.*")
    return read.unionByName(rest)


# --- page geometry -----------------------------------------------------------------------------------------------------
SPAN = "doc_id long, page int, block int, kind int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double, width double, height double"


def raw_blocks(spans: DataFrame) -> DataFrame:
    """Spans (``SPAN``) as raw blocks: spans of a line joined, lines by line ends, the size of the longest span; images and blank blocks go."""
    keys = ["doc_id", "page", "block"]
    text = spans.where("kind = 0 and text <> ''")
    pieces = F.array_sort(F.collect_list(F.struct("span", "text")))
    lines = text.groupBy(*keys, "line").agg(T.strip(F.array_join(F.transform(pieces, lambda x: x["text"]), "")).alias("text")).where("text <> ''")
    joined = F.array_sort(F.collect_list(F.struct("line", "text")))
    lines = lines.groupBy(*keys).agg(F.array_join(F.transform(joined, lambda x: x["text"]), "\n").alias("text"))
    first = F.struct(F.length("text").alias("n"), (-F.col("line")).alias("l"), (-F.col("span")).alias("s"), F.bround("size", 1).alias("size"))
    rest = text.groupBy(*keys).agg(F.max(first)["size"].alias("size"), *(F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")))
    return lines.join(rest, keys).withColumnRenamed("block", "idx").withColumn("chars", F.length("text"))


def from_spans(spans: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of page geometry; ``info``: doc_id, page_count, title, author as the file states them.

    Under the floor of characters a file has no text layer.  A producer's junk title gives way to the first heading's.
    """
    raw = raw_blocks(spans)
    chars = raw.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))
    floor = F.greatest(F.lit(MIN_CHARS_TOTAL), MIN_CHARS_PER_PAGE * F.col("page_count"))
    rows = info.join(chars, "doc_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)).cast("long"))
    kind = F.when(F.col("chars") < floor, "no_text_layer")
    message = F.concat(F.lit("no text layer: "), F.col("chars").cast("string"), F.lit(" characters on "), F.col("page_count").cast("string"), F.lit(" pages"))
    rows = rows.withColumn("failed", failed(kind, message))
    good = rows.where("failed.error is null").select("doc_id")
    placed = pdf.merge_headings(pdf.classify(pdf.reading_order(raw.join(good, "doc_id", "left_semi"))))
    clean = F.nullif(T.strip(F.col("title")), F.lit(""))
    stated = F.when(~F.coalesce(clean.rlike(r"(?i)^(microsoft word|untitled|document\d*)\b"), F.lit(True)), clean)
    heads = pdf.titles(placed).withColumnRenamed("title", "__head")
    rows = rows.join(heads, "doc_id", "left").withColumn("title", F.coalesce(stated, "__head")).withColumn("author", F.nullif(T.strip(F.col("author")), F.lit("")))
    null = F.lit(None).cast("int")
    blocks = placed.select("doc_id", "pos", "kind", "text", F.col("level").cast("int").alias("level"), null.alias("ordinal"), "page", "position")
    return rows.select("doc_id", "title", "author", "page_count", "chars", "failed.*"), blocks


# --- the run -----------------------------------------------------------------------------------------------------------
def spoken(documents: DataFrame, blocks: DataFrame, header: bool = True) -> DataFrame:
    """Nodes of documents: rules 1 to 9, the title's echo dropped, rules 10 to 15, the header ahead.  ``documents``: doc_id, title, author."""
    if not header:
        return S.to_nodes(B.normalise(blocks))
    return S.with_header(documents, S.to_nodes(S.drop_title_echo(B.normalise(blocks), documents)))


def estimate(documents: DataFrame, nodes: DataFrame, speed: float = 1.0) -> DataFrame:
    """doc_id, words, chars, extracted_words, extracted_blocks, pages, minutes: what a run would say, without an engine."""
    pages = F.col("page_count").cast("long") if "page_count" in documents.columns else F.lit(None).cast("long")
    rows = documents.select("doc_id", F.col("words").alias("extracted_words"), F.col("n_blocks").alias("extracted_blocks"), pages.alias("pages"))
    said = S.counts(nodes, speed)
    return rows.join(said, "doc_id", "left").select("doc_id", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), "extracted_words", "extracted_blocks", "pages", F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def carry_pauses(chunks: DataFrame) -> DataFrame:
    """Chunks that render to something; the pause of an empty one is added to the piece before it, or lost ahead of the first."""
    seq = Window.partitionBy("doc_id").orderBy("chunk_idx")
    rows = chunks.withColumn("__piece", F.sum((F.col("text") != "").cast("int")).over(seq))
    total = F.sum("pause_after_ms").over(Window.partitionBy("doc_id", "__piece"))
    return rows.withColumn("pause_after_ms", total).where("__piece > 0 and text <> ''").drop("__piece")


def run(documents: DataFrame, blocks: DataFrame, voice: str, speed: float = 1.0, engine: str = "kokoro", fmt: str = "mp3") -> DataFrame:
    """A row per document: its chunks, characters, time to speak, output name; documents with an error keep theirs."""
    info = engine_spec(engine)
    nodes = spoken(documents.where("error is null"), blocks)
    chunks = carry_pauses(S.chunks(nodes, info["max_chars"], info["style"]))
    rate = 15.57 * speed
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").cast("long").alias("chars"), F.sum("pause_after_ms").cast("long").alias("pause_ms"))
    ms = (F.round(F.col("chars") * 1000 / rate) + F.col("pause_ms")).cast("long")
    empty = F.when(F.col("error").isNull() & F.col("n_chunks").isNull(), F.lit("synthesis"))
    rows = documents.drop("blocks").join(per, "doc_id", "left").withColumn("error", F.coalesce("error", empty)).withColumn("code", error_code(F.col("error")))
    stem = O.default_stem(F.col("title"), F.lit(None).cast("string"), F.col("url"))
    rows = O.unique_stems(rows.withColumn("stem", F.when(F.col("error").isNull(), stem).otherwise(F.lit("document"))), "stem", "doc_id")
    ok = F.col("error").isNull()
    return rows.select("doc_id", "title", F.when(ok, F.lit(voice)).alias("voice"), F.when(ok, F.col("n_chunks")).alias("n_chunks"), F.when(ok, F.col("chars")).alias("chars"), F.when(ok, ms).alias("spoken_ms"), F.when(ok, F.concat("name", F.lit(f".{fmt}"))).alias("path"), "error", "code")


def transcripts(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """path, text of the spoken text beside each audio file: the same name with .txt."""
    return S.transcript(nodes).join(paths, "doc_id").select("doc_id", text_path(F.col("path")).alias("path"), "text")


def audio_path(requested: Column, stem: Column, fmt: str, is_dir: Column) -> Column:
    """An explicit path is taken literally; a folder gets the stem; one without a suffix gets the format's."""
    last = F.regexp_extract(requested, r"([^/]*)$", 1)
    plain = ~last.rlike(r"^.+\.[^.]+$")
    inside = F.concat(F.regexp_replace(requested, "/+$", ""), F.lit("/"), stem, F.lit(f".{fmt}"))
    return F.when(requested.isNull(), F.concat(stem, F.lit(f".{fmt}"))).when(is_dir, inside).when(plain, F.concat(requested, F.lit(f".{fmt}"))).otherwise(requested)


def text_path(audio: Column) -> Column:
    return F.concat(F.regexp_replace(audio, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def changed_lines(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_id, added, removed: lines (doc_id, line) that only one side has, with their multiplicity, both ways."""
    key = ["doc_id", "line"]
    both = expected.select(*key, F.lit(-1).alias("d")).unionByName(actual.select(*key, F.lit(1).alias("d")))
    net = both.groupBy(*key).agg(F.sum("d").alias("d")).where("d <> 0")
    return net.groupBy("doc_id").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


def speaking_rates(rows: DataFrame) -> DataFrame:
    """kind, n, least, median, mean, most characters a second, and the tightest ratio of the mean of all to a rate, by kind; from (kind, chars, seconds)."""
    rates = rows.where("seconds > 0").withColumn("rate", F.col("chars") / F.col("seconds"))
    mean = rates.agg(F.avg("rate").alias("all_mean"))
    stats = rates.groupBy("kind").agg(F.count("*").alias("n"), F.min("rate").alias("least"), F.median("rate").alias("median"), F.avg("rate").alias("mean"), F.max("rate").alias("most"))
    # One row of one number.
    return stats.join(F.broadcast(mean)).withColumn("tightest", F.col("all_mean") / F.col("most")).drop("all_mean")


# --- voices and engines ------------------------------------------------------------------------------------------------
#: What the chunker must know of each engine.
ENGINES = {"kokoro": {"max_chars": V.MAX_CHARS, "style": "silence"}, "say": {"max_chars": 100_000, "style": "say"}}
#: Accents of the English locales that the system voices have.
LOCALES = {"en_GB": "uk", "en_US": "us", "en_AU": "au", "en_IE": "ie", "en_IN": "in", "en_ZA": "za", "en_NZ": "nz", "en_CA": "ca"}
#: System voices whose gender is known.
GENDERS = {
    "female": "Kate Serena Fiona Stephanie Samantha Allison Ava Susan Zoe Karen Moira Veena Tessa Catherine Isha Nicky Joelle Sandy Shelley".split(),
    "male": "Daniel Oliver Alex Tom Fred Evan Nathan Lee Rishi Gordon Jamie Aaron Ralph Junior".split(),
}


def engine_spec(name: str) -> dict:
    """An engine by its name in any case; an unknown one is a usage error that names the others."""
    if (found := ENGINES.get(name.lower())) is None:
        raise ValueError(f"unknown engine {name!r}; available: {', '.join(sorted(ENGINES))}")
    return found


def listed_voices(spark: SparkSession) -> DataFrame:
    """pref, id, name, accent, gender, description."""
    return O.voices(spark).select("pref", "id", F.col("id").alias("name"), "accent", "gender", F.concat(F.lit("grade "), "grade").alias("description"))


def system_voices(lines: DataFrame) -> DataFrame:
    """pref, id, name, accent, gender of voice lines (pref, line: name, locale, sample) with an English accent."""
    pattern = r"^(.+?)\s{2,}([a-z]{2}_[A-Z]{2})\s+#"
    accent = F.create_map(*(F.lit(x) for kv in LOCALES.items() for x in kv))[F.regexp_extract("line", pattern, 2)]
    name = F.trim(F.regexp_extract("line", pattern, 1))
    bare = F.split(name, r" \(", -1)[0]
    gender = F.when(bare.isin(GENDERS["female"]), "female").when(bare.isin(GENDERS["male"]), "male")
    return lines.select("pref", name.alias("id"), bare.alias("name"), accent.alias("accent"), gender.alias("gender")).where("accent is not null")


def nearest_voice(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """``asked`` (id, accent, gender) with chosen: by accent and gender, else accent, else gender, else the first voice."""
    v = voices.select(F.col("id").alias("chosen"), F.col("accent").alias("va"), F.col("gender").alias("vg"), "pref")
    a, g = F.coalesce(F.col("va") == F.col("accent"), F.lit(False)), F.coalesce(F.col("vg") == F.col("gender"), F.lit(False))
    score = F.when(a & g, 0).when(a, 1).when(g, 2).otherwise(3)
    # The voices are a list of some dozen rows.
    rows = asked.join(F.broadcast(v), F.lit(True), "left").groupBy("id", "accent", "gender").agg(F.min_by("chosen", F.struct(score, "pref")).alias("chosen"))
    return rows.withColumn("error", F.when(F.col("chosen").isNull(), "synthesis"))


def fallback_warnings(chosen: DataFrame, voices: DataFrame) -> DataFrame:
    """``chosen`` (id, accent, gender, voice, chosen) with warning where accent or gender had to give way; none for an explicit voice."""
    v = voices.select(F.col("id").alias("chosen"), F.col("accent").alias("va"), F.col("gender").alias("vg"))
    rows = chosen.join(F.broadcast(v), "chosen", "left")
    missed = F.array(F.when(F.col("va") != F.col("accent"), F.concat(F.lit("accent "), "accent")), F.when(F.col("vg") != F.col("gender"), F.concat("gender", F.lit(" voice"))))
    missed = F.filter(missed, lambda x: x.isNotNull())
    warn = F.col("voice").isNull() & F.col("chosen").isNotNull() & (F.size(missed) > 0)
    said = F.concat(F.lit("no "), F.array_join(missed, " and no "), F.lit("; using "), "chosen", F.lit(" ("), F.coalesce("va", F.lit("?")), F.lit("/"), F.coalesce("vg", F.lit("?")), F.lit(")"))
    return rows.withColumn("warning", F.when(warn, said)).drop("va", "vg")


# --- audio -------------------------------------------------------------------------------------------------------------
def from_samples(samples: np.ndarray) -> bytes:
    """WAV of samples from -1 to 1: clipped, scaled to 16 bits, cut towards zero.  Samples that are no number are an error."""
    if not np.isfinite(samples).all():
        raise ValueError("samples that are no number")
    return O.wav((np.clip(samples, -1.0, 1.0) * 32767.0).astype("<i2").tobytes())


def wav_seconds(data: bytes | None) -> float:
    """Seconds of a WAV; 0 for what isn't one."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError):
        return 0.0


def stitch(pieces: DataFrame, audio: bool = True) -> DataFrame:
    """doc_id, audio, seconds: the WAVs of a document's pieces (doc_id, chunk_idx, audio, pause_after_ms) with their silences, in order.

    The pieces' audio may be as ``output.packed`` gives it.  Rows come sorted by document, so that a task holds a piece, and
    the WAV it writes only if ``audio`` is asked for; without, doc_id and the seconds of the same frames.
    """
    spark = pieces.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("doc_id", pa.int64()), *([("audio", pa.binary())] if audio else []), ("seconds", pa.float64())])

    def joined(mine):
        out, w, frames, rate = io.BytesIO(), None, 0, 0
        for _, piece, pause in mine:
            with wave.open(io.BytesIO(O.unpacked(piece.as_py())), "rb") as part:
                size, sound = part.getsampwidth() * part.getnchannels(), part.readframes(part.getnframes())
                gap = b"\0" * (int(part.getframerate() * pause / 1000) * size)
                frames, rate = frames + (len(sound) + len(gap)) // size, rate or part.getframerate()
                if audio and w is None:
                    w = wave.open(out, "wb")
                    w.setparams(part.getparams())
            if audio:
                w.writeframesraw(sound)
                w.writeframesraw(gap)
        if audio:
            w.close()
        return out.getvalue(), frames / rate

    def run(batches):
        rows = (r for b in batches for r in zip(b["doc_id"].to_pylist(), b["audio"], b["pause_after_ms"].to_pylist(), strict=True))
        held, size = [], 0
        for doc, mine in groupby(rows, key=lambda r: r[0]):
            wav, seconds = joined(mine)
            held.append({"doc_id": doc, "seconds": seconds} | ({"audio": wav} if audio else {}))
            size += len(wav)
            if len(held) >= 1000 or size >= O.BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    rows = pieces.select("doc_id", "chunk_idx", "audio", "pause_after_ms").repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "chunk_idx")
    return rows.mapInArrow(run, f"doc_id long, {'audio binary, ' if audio else ''}seconds double")
