"""Blocks -> speech nodes (doc_id, seq, node, text, ms), and what is computed from them."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions import values as V

NUL = "\x00"


def expand(df: DataFrame, col: str = "text", ascii_links: bool = False) -> DataFrame:
    """Rules 10 and 11.  Texts without anything to protect take the short way.  ``ascii_links``: see ``text.links``."""
    keep = df.columns
    df = df.withColumn(col, T.links(F.col(col), ascii_links))
    none = F.array().cast("array<string>")
    df = df.withColumn("__stash", none).withColumn("__t", F.col(col)).withColumn("__may", F.col(col).rlike(T.U + V.MAY_PROTECT))
    for p in V.PROTECTED:
        p = T.U + p
        found = F.when(F.col("__may"), F.regexp_extract_all("__t", F.lit(p), F.lit(0))).otherwise(none)
        marks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__hit"), F.lit(1))), lambda i: F.when(i <= F.size("__hit"), F.concat(F.lit(NUL), (i - 1 + F.size("__stash")).cast("string"), F.lit(NUL))))
        parts = F.zip_with(F.split("__t", p, -1), marks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        df = df.withColumn("__hit", found).withColumn("__t", F.when(F.size("__hit") > 0, F.array_join(parts, "")).otherwise(F.col("__t"))).withColumn("__stash", F.concat("__stash", "__hit"))
    df = df.withColumn("__t", T.expansions(F.col("__t")))
    back = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("__stash") - 1, F.lit(0))), F.col("__t"), lambda t, i: F.replace(t, F.concat(F.lit(NUL), i.cast("string"), F.lit(NUL)), F.coalesce(F.get("__stash", i), F.lit(""))))
    df = df.withColumn("__t", F.when((F.size("__stash") > 0) | F.col("__t").contains(NUL), back).otherwise(F.col("__t")))
    return df.withColumn(col, T.strip(T.squeeze(F.col("__t")))).select(*keep)


def to_nodes(blocks: DataFrame) -> DataFrame:
    """Rules 10 to 15: blocks become nodes; runs of list items are announced when longer than 12."""
    seq = Window.partitionBy("doc_id").orderBy("pos")
    item = F.col("kind") == "list_item"
    df = blocks.withColumn("text", F.when(F.col("kind").isin("list_item", "heading"), T.ensure_terminal(F.col("text"))).otherwise(F.col("text")))
    df = expand(df)
    first = item & ~F.coalesce(F.lag(item).over(seq), F.lit(False))
    last = item & ~F.coalesce(F.lead(item).over(seq), F.lit(False))
    df = df.withColumn("__first", first).withColumn("__last", last)
    df = df.withColumn("__run", F.when(item, F.sum(F.col("__first").cast("int")).over(seq)))
    df = df.withColumn("__size", F.when(item, F.count("*").over(Window.partitionBy("doc_id", "__run"))))
    said = T.spelled(F.col("text"))
    none = F.array().cast("array<struct<node:string,text:string,ms:int>>")
    announce = F.when(F.col("__first") & (F.col("__size") > 12), F.array(T.node("Say", F.concat(F.lit("A list of "), F.col("__size").cast("string"), F.lit(" items."))), T.pause(V.PARAGRAPH))).otherwise(none)
    number = F.when(F.coalesce(F.col("ordinal"), F.lit(0)) != 0, F.array(T.node("Say", F.concat(T.ordinal_word(F.col("ordinal")), F.lit("."))))).otherwise(none)
    closing = F.when(F.col("__last"), F.array(T.pause(V.LIST_ITEM), T.pause(V.PARAGRAPH))).otherwise(F.array(T.pause(V.LIST_ITEM)))
    before = F.array(T.pause(F.when(F.coalesce(F.col("level"), F.lit(0)) <= 1, V.SECTION).otherwise(V.HEADING_BEFORE)))
    nodes = F.when(item, F.concat(announce, number, said, closing)).when(F.col("kind") == "heading", F.concat(before, said, F.array(T.pause(V.HEADING_AFTER)))).otherwise(F.concat(said, F.array(T.pause(V.PARAGRAPH))))
    rows = df.select("doc_id", "pos", F.posexplode(nodes).alias("i", "x")).select("doc_id", "pos", "i", "x.*")
    return tidy(rows)


def header(documents: DataFrame) -> DataFrame:
    """Rule 14: node rows ahead of a document, from (doc_id, title, author): the title, then a plausible author, each with the longest pause."""
    by = F.when(T.plausible_author(F.col("author")), F.concat(F.lit("By "), F.col("author")))
    rows = documents.select("doc_id", F.posexplode(F.filter(F.array(F.nullif("title", F.lit("")), by), lambda x: x.isNotNull())).alias("i", "text"))
    rows = expand(rows.withColumn("text", T.ensure_terminal(F.col("text"))))
    nodes = F.concat(T.spelled(F.col("text")), F.array(T.pause(V.SECTION)))
    return rows.select("doc_id", (F.col("i") - 2).alias("pos"), F.posexplode(nodes).alias("i", "x")).select("doc_id", "pos", "i", "x.*")


def with_header(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Header nodes, then a document's nodes, tidied as one."""
    body = nodes.select("doc_id", "seq", F.lit(0).alias("i"), "node", "text", "ms").withColumnRenamed("seq", "pos")
    return tidy(header(documents).unionByName(body))


def drop_title_echo(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The first block goes if it is a heading whose tokens resemble the title's (ratio 0.8 or more)."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) == 1
    rows = blocks.withColumn("__first", first).join(documents.select("doc_id", F.col("title").alias("__title")), "doc_id", "left")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, list(x), list(y)).ratio() >= 0.8 for x, y in zip(a, b, strict=True)], dtype=bool)

    ask = F.col("__first") & (F.col("kind") == "heading") & (F.coalesce("__title", F.lit("")) != "")
    # One pass: all but first headings send two empty lists.
    none = F.array().cast("array<string>")
    echo = similar(F.when(ask, T.tokens(F.col("text"))).otherwise(none), F.when(ask, T.tokens(F.col("__title"))).otherwise(none))
    return rows.where(~(ask & echo)).select(*blocks.columns)


def plain_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: a readable rendering of blocks as extracted."""
    text, level = T.strip(T.re_sub(F.col("text"), T.U + r"\s+", " ")), F.greatest(F.lit(1), F.coalesce("level", F.lit(0)))
    marker = F.when(F.coalesce("ordinal", F.lit(0)) != 0, F.concat(F.col("ordinal").cast("string"), F.lit("."))).otherwise("-")
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n")))
    line = line.when(F.col("kind") == "list_item", F.concat(marker, F.lit(" "), text)).when(F.col("kind") == "quote", F.concat(F.lit("> "), text, F.lit("\n")))
    line = line.when(F.col("kind").isin("caption", "table"), F.concat(F.lit("["), F.col("kind"), F.lit("] "), text, F.lit("\n")))
    line = line.when(F.col("kind") == "code", F.concat(F.lit("[code]\n"), text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("p"))))
    rows = blocks.where(text != "")
    return rows.groupBy("doc_id").agg(F.concat(T.strip(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n")), F.lit("\n")).alias("text"))


def tidy(rows: DataFrame) -> DataFrame:
    """Rule 15b on (doc_id, pos, i, node, text, ms): empty nodes go, neighbouring pauses become their longest, ends are trimmed."""
    rows = rows.where((F.col("node") != "Pause") & (T.strip(F.coalesce("text", F.lit(""))) != "") | (F.col("node") == "Pause") & (F.col("ms") > 0))
    spoken = F.col("node") != "Pause"
    seq = Window.partitionBy("doc_id").orderBy("pos", "i")
    rows = rows.withColumn("isle", F.sum(spoken.cast("int")).over(seq)).withColumn("all", F.sum(spoken.cast("int")).over(Window.partitionBy("doc_id")))
    isle = Window.partitionBy("doc_id", "isle", "node").orderBy("pos", "i")
    rows = rows.withColumn("ms", F.when(~spoken, F.max("ms").over(Window.partitionBy("doc_id", "isle", "node")))).withColumn("k", F.row_number().over(isle))
    rows = rows.where(spoken | ((F.col("k") == 1) & (F.col("isle") > 0) & (F.col("isle") < F.col("all"))))
    return rows.withColumn("seq", (F.row_number().over(seq) - 1).cast("int")).select("doc_id", "seq", "node", "text", "ms")


def counts(nodes: DataFrame, speed: float = 1.0) -> DataFrame:
    """doc_id, words, chars, minutes."""
    spoken = F.col("node") != "Pause"
    n = F.sum(F.when(spoken, T.words(F.col("text"))).otherwise(0))
    silence = F.coalesce(F.sum(F.when(~spoken, F.col("ms"))), F.lit(0)) / 60000.0
    return nodes.groupBy("doc_id").agg(n.alias("words"), F.sum(F.when(spoken, F.length("text")).otherwise(0)).cast("long").alias("chars"), F.round(n / (V.WORDS_PER_MINUTE * speed) + silence, 6).alias("minutes"))


def head(nodes: DataFrame, words: int = 150) -> DataFrame:
    """The first nodes of each document within a budget of words; at least the first spoken one."""
    seq = Window.partitionBy("doc_id").orderBy("seq")
    w = F.when(F.col("node") != "Pause", T.words(F.col("text"))).otherwise(0)
    df = nodes.withColumn("w", w).withColumn("upto", F.sum("w").over(seq)).withColumn("rn", F.row_number().over(seq))
    stop = ((F.col("node") != "Pause") & (F.col("upto") > words) & (F.col("rn") > 1)) | (F.col("upto") - F.col("w") >= words)
    df = df.withColumn("stopped", F.max(stop.cast("int")).over(seq))
    return df.where("stopped = 0").select(*nodes.columns)


def _joined(nodes: DataFrame, piece, sep: str, keys=("doc_id",)):
    ordered = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("seq", piece.alias("p")))))
    return nodes.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), sep).alias("text"))


def serialize(nodes: DataFrame) -> DataFrame:
    line = F.when(F.col("node") == "Say", F.concat(F.lit("SAY   "), "text")).when(F.col("node") == "Spell", F.concat(F.lit("SPELL "), "text")).otherwise(F.concat(F.lit("PAUSE "), F.col("ms").cast("string")))
    return _joined(nodes, line, "\n").withColumn("text", F.concat("text", F.lit("\n")))


def transcript(nodes: DataFrame) -> DataFrame:
    """Paragraphs break at pauses of 400 ms and more."""
    seq = Window.partitionBy("doc_id").orderBy("seq")
    long = (F.col("node") == "Pause") & (F.col("ms") >= V.HEADING_AFTER)
    df = nodes.withColumn("par", F.sum(long.cast("int")).over(seq)).where("node <> 'Pause'")
    pars = _joined(df, F.col("text"), " ", ("doc_id", "par"))
    ordered = F.array_sort(F.collect_list(F.struct("par", "text")))
    out = pars.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))
    return nodes.select("doc_id").distinct().join(out, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("\n")).alias("text"))


def escape_ssml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def piece(style: str):
    """What a node contributes to the text in the given style; null for nothing."""
    text, ms = F.col("text"), F.col("ms")
    spell = {"ssml": F.concat(F.lit('<say-as interpret-as="characters">'), escape_ssml(text), F.lit("</say-as>")), "say": F.concat(F.lit("[[char LTRL]]"), text, F.lit("[[char NORM]]"))}.get(style, T.letters(text))
    rest = {
        "ssml": F.concat(F.lit('<break time="'), ms.cast("string"), F.lit('ms"/>')),
        "say": F.concat(F.lit("[[slnc "), ms.cast("string"), F.lit("]]")),
        "tag": F.when(ms >= V.HEADING_BEFORE, "[long pause]").when(ms >= V.PARAGRAPH, "[pause]").otherwise("[short pause]"),
    }.get(style, F.lit(None).cast("string"))
    say = escape_ssml(text) if style == "ssml" else text
    return F.nullif(F.when(F.col("node") == "Say", say).when(F.col("node") == "Spell", spell).when(ms > 0, rest), F.lit(""))


def render(nodes: DataFrame, style: str, keys=("doc_id",)) -> DataFrame:
    out = _joined(nodes, piece(style), " ", keys)
    return out.withColumn("text", T.strip(T.re_sub(F.col("text"), "  +", " ")))


def runs(nodes: DataFrame, style: str = "silence") -> DataFrame:
    """doc_id, run_id, text (rendered), n_chars, pause_after_ms: what lies between two pauses."""
    return _runs(nodes, style).drop("parts")


def _runs(nodes: DataFrame, style: str) -> DataFrame:
    """As ``runs``, with the nodes themselves as ``parts``."""
    seq = Window.partitionBy("doc_id").orderBy("seq")
    after = F.when(F.col("node") == "Pause", F.col("ms"))
    before = F.coalesce(F.sum(F.when(F.col("node") == "Pause", 1).otherwise(0)).over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = nodes.withColumn("run_id", before.cast("int")).withColumn("after", after)
    spoken = F.when((F.col("node") != "Pause") & piece(style).isNotNull(), F.struct("seq", piece(style).alias("p"), "node", "text"))
    out = df.groupBy("doc_id", "run_id").agg(F.array_sort(F.collect_list(spoken)).alias("parts"), F.coalesce(F.max("after"), F.lit(0)).alias("pause_after_ms"), F.max((F.col("node") != "Pause").cast("int")).alias("any"))
    text = F.array_join(F.transform("parts", lambda x: x["p"]), " ")
    out = out.where("any = 1").withColumn("text", T.strip(T.re_sub(text, "  +", " ")))
    return out.select("doc_id", "run_id", "text", F.length("text").alias("n_chars"), "pause_after_ms", "parts")


_NEVER = {a.lower() for a in V.NEVER_END}


def is_sentence_end(token: str) -> bool:
    if token[-1:] in ("!", "?"):
        return True
    return token.endswith(".") and token.lower() not in _NEVER and not re.search(r"\b[A-Z]\.$", token)


def rendered(node: str, text: str, style: str) -> str:
    """What a spoken node contributes to the text in the given style."""
    if style == "ssml":
        text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    if node != "Spell":
        return text
    if style == "ssml":
        return f'<say-as interpret-as="characters">{text}</say-as>'
    if style == "say":
        return f"[[char LTRL]]{text}[[char NORM]]"
    return ". ".join(c for c in text if not c.isspace()) + "."


class _Sentence:
    """Neighbouring units of a run: words of Say nodes, and Spell nodes, which are never cut and end no sentence."""

    def __init__(self, units):
        self.units = units  # (plain, as rendered, is it a word)
        self.text = re.sub("  +", " ", " ".join(u[1] for u in units if u[1])).strip()

    def cut(self, limit: int):
        """(part, was it cut at a mere word) of a sentence over the limit: after the last clause mark of what fits, else its last unit; the rest whole where not even one fits."""
        units = self.units
        while len((whole := _Sentence(units)).text) > limit:
            ends = [0]
            for _, shown, _ in units:
                ends.append(ends[-1] + len(shown) + 1)
            fit = sum(end - 1 <= limit for end in ends[1:])
            clause = max((i + 1 for i, (plain, _, word) in enumerate(units[:fit]) if word and plain[-1] in ";:,—"), default=0)
            if not fit:
                break
            yield _Sentence(units[: clause or fit]), not clause
            units = units[clause or fit :]
        else:
            if not units:
                return
        yield whole, False


def pack_nodes(parts: list[tuple[str, str]], limit: int, style: str = "silence") -> list[tuple[str, str | None]]:
    """(text, near) of a run's pieces: whole sentences, greedily, of at most ``limit`` characters as rendered.

    ``near``: the first 60 characters of what was said, where a sentence had to be cut at a mere word.
    """
    units = [(t, rendered(k, t, style), False) if k == "Spell" else (w, rendered(k, w, style), True) for k, t in parts for w in ([t] if k == "Spell" else t.split())]
    whole = _Sentence([(t, rendered(k, t, style), k != "Spell") for k, t in parts])
    if len(whole.text) <= limit:
        return [(whole.text, None)]
    ends = [i + 1 for i, (plain, _, word) in enumerate(units) if word and is_sentence_end(plain)]
    bounds = sorted({0, *ends, len(units)})
    out: list[tuple[str, str | None]] = []
    held: list[str] = []

    def flush():
        if held:
            out.append((" ".join(held), None))
            held.clear()

    for a, b in zip(bounds, bounds[1:], strict=False):
        sentence = _Sentence(units[a:b])
        if len(sentence.text) > limit:
            flush()
            out += [(p.text, " ".join(u[0] for u in p.units)[:60] if at_word else None) for p, at_word in sentence.cut(limit)]
            continue
        if held and sum(map(len, held)) + len(held) + len(sentence.text) > limit:
            flush()
        held.append(sentence.text)
    flush()
    return out


def pack(text: str, limit: int) -> list[str]:
    """The pieces of a plain text."""
    return [t for t, _ in pack_nodes([("Say", text)], limit)]


def chunks(nodes: DataFrame, limit: int = V.MAX_CHARS, style: str = "silence") -> DataFrame:
    """doc_id, chunk_idx, run_id, text, n_chars, pause_after_ms, near (see ``pack_nodes``).  Only runs over the limit go to Python."""
    r = _runs(nodes, style)

    @F.pandas_udf("array<struct<text:string,near:string>>")
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda run: [{"text": t, "near": n} for t, n in pack_nodes([(x["node"], x["text"]) for x in run], limit, style)])

    whole = F.array(F.struct("text", F.lit(None).cast("string").alias("near")))
    long = r.where(F.col("n_chars") > limit).withColumn("pieces", packed("parts"))
    rows = r.where(F.col("n_chars") <= limit).withColumn("pieces", whole).drop("parts").unionByName(long.drop("parts"))
    rows = rows.select("doc_id", "run_id", "pause_after_ms", F.size("pieces").alias("k"), F.posexplode("pieces").alias("i", "x")).select("*", "x.text", "x.near")
    seq = Window.partitionBy("doc_id").orderBy("run_id", "i")
    return rows.select("doc_id", (F.row_number().over(seq) - 1).cast("int").alias("chunk_idx"), "run_id", "text", F.length("text").alias("n_chars"), F.when(F.col("i") == F.col("k") - 1, F.col("pause_after_ms")).otherwise(0).alias("pause_after_ms"), "near")


def chunk_keys(c: DataFrame, voice: str, speed: float = 1.0, engine: str = "kokoro") -> DataFrame:
    """Content address of each chunk's audio."""
    payload = F.concat_ws(NUL, F.lit(engine), F.lit(voice), F.lit(str(float(speed))), F.col("text"))
    return c.withColumn("key", F.substring(F.sha2(payload, 256), 1, 32))


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, text) that the cache lacks: each is synthesised once however many documents share it."""
    return keyed.groupBy("key").agg(F.min("text").alias("text")).join(cache.select("key"), "key", "left_anti")


def timeline(c: DataFrame) -> DataFrame:
    """start_ms, end_ms of each chunk with (doc_id, chunk_idx, duration_ms, pause_after_ms)."""
    seq = Window.partitionBy("doc_id").orderBy("chunk_idx")
    upto = F.sum(F.col("duration_ms") + F.col("pause_after_ms")).over(seq)
    return c.withColumn("end_ms", upto - F.col("pause_after_ms")).withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def truncation_ok(n_samples, n_chars, speed):
    """Guard: at least 60 characters must last 0.55 of what they take at 15.57 characters a second; empty audio never passes."""
    seconds = n_samples / 24000.0
    return (n_samples > 0) & ((n_chars < 60) | (seconds >= 0.55 * n_chars / (15.57 * speed)))
