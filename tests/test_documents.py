"""Whole documents: markup, chunks of nodes, names, errors, audio, geometry."""

import io
import random
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import documents as D
from lectern.operators import output as O
from lectern.operators import speech as S
from lectern.sources import landing, web


def test_outer_markup_owns_its_text():
    kinds = lambda html: [(r[0], r[1], r[3]) for r in web.parse_blocks(html)[1]]
    assert kinds("<blockquote><p>x</p></blockquote>") == [("quote", "x", None)]
    assert kinds("<ol><li><p>x</p></li><li>y</li></ol>") == [("list_item", "x", 1), ("list_item", "y", 2)]
    assert kinds("<table><tr><td>Total <b>cost</b></td><td>5</td></tr></table>") == [("table", "Total cost | 5", None)]
    assert kinds("<table><tr><td><p>a</p></td><td><p>b</p><p>c</p></td></tr></table><p>d") == [("table", "a | b c", None), ("paragraph", "d", None)]
    assert kinds("<blockquote>a<blockquote>b</blockquote>c</blockquote>d") == [("quote", "a b c", None), ("paragraph", "d", None)]
    assert kinds("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>") == [("list_item", "a", None), ("list_item", "b", None), ("list_item", "c", None)]
    assert kinds("<p>one<script>x</script> two</p>") == [("paragraph", "one two", None)]


def spell_shown(text, style):
    return {"ssml": f'<say-as interpret-as="characters">{text}</say-as>', "say": f"[[char LTRL]]{text}[[char NORM]]"}.get(style, ". ".join(text) + ".")


@pytest.mark.parametrize("style", ["silence", "ssml", "say", "tag"])
def test_pieces_keep_words_order_and_spelled_nodes_whole(style):
    rng = random.Random(7)
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) + rng.choice(["", "", "", ",", ".", "!", ";"]) for _ in range(rng.randrange(1, 12))]
            parts.append(("Say", " ".join(words)))
            if rng.random() < 0.5:
                parts.append(("Spell", rng.choice(["HTTPS", "US", "MP"])))
        limit = rng.choice([16, 30, 60, 200])
        units = [u for k, t in parts for u in ([spell_shown(t, style)] if k == "Spell" else t.split())]
        pieces = S.pack_nodes(parts, limit, style)
        assert " ".join(t for t, _ in pieces) == " ".join(units)
        left = list(units)
        for text, near in pieces:
            mine = []
            while " ".join(mine) != text:  # pieces end between units
                mine.append(left.pop(0))
            assert len(text) <= limit or len(mine[0]) > limit  # nothing is cut before a unit that can't fit
            assert near is None or not S.is_sentence_end(mine[-1])


def test_a_spelled_node_is_never_cut():
    parts = [("Say", "aaaa bbbb"), ("Spell", "HTTPS"), ("Say", "cccc dddd.")]
    assert [t for t, _ in S.pack_nodes(parts, 16)] == ["aaaa bbbb", "H. T. T. P. S.", "cccc dddd."]
    assert S.pack_nodes([("Say", "one two three four")], 9) == [("one two", "one two"), ("three", "three"), ("four", None)]
    assert S.pack_nodes([("Say", "one, two three four")], 9) == [("one,", None), ("two three", "two three"), ("four", None)]


def test_chunks_of_nodes(spark):
    rows = [(1, 0, "Say", "Alpha beta.", None), (1, 1, "Spell", "US", None), (1, 2, "Say", "gamma delta.", None), (1, 3, "Pause", None, 500), (1, 4, "Say", "End.", None)]
    nodes = spark.createDataFrame(rows, "doc_id long, seq int, node string, text string, ms int")
    out = S.chunks(nodes, 18).orderBy("chunk_idx").collect()
    assert [(r["run_id"], r["text"], r["pause_after_ms"]) for r in out] == [(0, "Alpha beta.", 0), (0, "U. S. gamma delta.", 500), (1, "End.", 0)]
    assert [r["text"] for r in S.chunks(nodes, 200, "ssml").orderBy("chunk_idx").collect()][0] == 'Alpha beta. <say-as interpret-as="characters">US</say-as> gamma delta.'


def test_names_never_clash(spark):
    rng = random.Random(3)
    for stems in (["a", "a", "a-2"], ["a"] * 9 + ["a-2", "a-3", "a-5", "a-5"], [rng.choice(["x", "x-2", "x-2-2", "x-3", "y", "x-02"]) for _ in range(300)]):
        rows = spark.createDataFrame(list(enumerate(stems)), "k long, stem string")
        names = [r["name"] for r in O.unique_stems(rows, "stem", "k").collect()]
        assert len(set(names)) == len(stems) and set(stems) <= set(names)


def naive_duplicates(rows):
    gone = set()
    for pos, can, t in sorted(rows):
        for p, _, other in sorted(rows):
            if can and pos not in gone and p != pos and p not in gone and len(other) > len(t):
                run = any(other[i : i + len(t)] == t for i in range(len(other) - len(t) + 1))
                if run or (0.739 * len(other) <= len(t) <= 0.95 * len(other) and B.ratio(t, other) >= 0.85):
                    gone.add(pos)
    return gone


def test_duplicates_against_a_plain_double_loop(spark):
    rng = random.Random(5)
    rows = []
    for d in range(40):
        base = [rng.choice("abcdefghijklmnop") * 2 for _ in range(24)]
        for pos in range(8):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = "zz"
            a = rng.randrange(3)
            rows.append((d, pos, rng.choice(["quote", "paragraph", "heading"]), " ".join(t[a : rng.randrange(18, 25)])))
    frame = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string")
    left = {(r["doc_id"], r["pos"]) for r in B.drop_duplicates(frame).collect()}
    gone = 0
    for d in range(40):
        mine = [(pos, kind != "heading", text.split()) for i, pos, kind, text in rows if i == d]
        bad = naive_duplicates(mine)
        gone += len(bad)
        assert {p for i, p in left if i == d} == {p for p, *_ in mine} - bad
    assert gone > 20


def test_wraps_use_the_words_of_their_document(spark):
    frame = spark.createDataFrame([(1, 0, "a self-\nmade man and a wo-\nman"), (1, 1, "He is self-made."), (2, 0, "self-\nmade")], "doc_id long, pos int, text string")
    assert sorted(r["text"] for r in B.repair_wraps(frame).collect()) == ["He is self-made.", "a self-made man and a woman", "selfmade"]


def test_running_lines(spark):
    rows = [(1, i, "paragraph", f"Page {i} of 9", 0, None, i, 0.5) for i in range(1, 4)] + [(1, 10 + i, "paragraph", "Edge line", 0, None, i, 0.95) for i in (1, 2)] + [(1, 20 + i, "paragraph", "mid line", 0, None, i, 0.5) for i in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, level int, ordinal int, page int, position double")
    assert {r["text"] for r in B.drop_running(frame).collect()} == {"mid line"}


def test_audio(spark):
    data = D.from_samples(np.array([0.0, 2.0, -2.0, 0.5]))
    with wave.open(io.BytesIO(data)) as w:
        assert np.frombuffer(w.readframes(4), "<i2").tolist() == [0, 32767, -32767, 16383]
    with pytest.raises(ValueError):
        D.from_samples(np.array([np.nan]))
    assert D.wav_seconds(O.silence(500)) == 0.5 and D.wav_seconds(b"no") == 0.0 and D.wav_seconds(None) == 0.0
    rows = [(1, 1, O.silence(250), 100), (1, 0, D.from_samples(np.ones(2400)), 50)]
    out = D.stitch(spark.createDataFrame(rows, "doc_id long, chunk_idx int, audio binary, pause_after_ms int")).collect()[0]
    assert out["seconds"] == pytest.approx(0.1 + 0.05 + 0.25 + 0.1)
    with wave.open(io.BytesIO(bytes(out["audio"]))) as w:
        assert np.frombuffer(w.readframes(2401), "<i2")[[0, 2399, 2400]].tolist() == [32767, 32767, 0]


def test_geometry_to_documents(spark):
    rows = [(1, 1, 0, 0, 0, 0, "A Great ", 20.0, 50.0, 30.0, 300.0, 50.0), (1, 1, 0, 0, 0, 1, "Heading", 20.0, 50.0, 30.0, 300.0, 50.0), (1, 1, 1, 1, 0, 0, "picture", 9.0, 0.0, 0.0, 9.0, 9.0)]
    rows += [(1, 1, 2, 0, i, 0, f"line {i} of the body text of this page", 10.0, 50.0, 100.0, 500.0, 300.0) for i in range(6)]
    rows += [(2, 1, 0, 0, 0, 0, "scan", 10.0, 0.0, 0.0, 9.0, 9.0)]
    spans = spark.createDataFrame([(*r, 612.0, 792.0) for r in rows], D.SPAN)
    info = spark.createDataFrame([(1, 1, "Microsoft Word - doc1", " Ann Lee "), (2, 3, None, None)], "doc_id long, page_count int, title string, author string")
    docs, blocks = D.from_spans(spans, info)
    found = {r["doc_id"]: r for r in docs.collect()}
    assert (found[1]["title"], found[1]["author"], found[1]["error"]) == ("A Great Heading", "Ann Lee", None)
    assert (found[2]["error"], found[2]["code"]) == ("no_text_layer", 7)
    assert [(r["kind"], r["text"].count("\n")) for r in blocks.orderBy("pos").collect()] == [("heading", 0), ("paragraph", 5)]


def test_errors_are_rows(spark, tmp_path):
    def get(url, plain):
        if "bad" in url:
            raise OSError("no route")
        return url, 200, "text/html", b"<p>x"

    urls = spark.createDataFrame([("https://bad.org",), ("https://good.org",)], "url string")
    got = {r["url"]: r for r in landing.fetch(urls, get).collect()}
    assert got["https://bad.org"]["status"] is None and got["https://good.org"]["status"] == 200
    assert D.engine_spec("SAY")["style"] == "say"
    with pytest.raises(ValueError, match="kokoro, say"):
        D.engine_spec("other")
    page = "<h1>Big Title - Example</h1>" + "<p>" + "word " * 30 + "</p>"
    frame = spark.createDataFrame([(1, "https://www.example.com/a", f"<title>Big Title - Example</title>{page}"), (2, "https://www.example.com/b", "<p>short</p>")], "doc_id long, url string, html string")
    docs = D.from_html(frame).withColumn("author", F.lit("Jane Doe"))
    out = {r["doc_id"]: r for r in D.run(docs, D.blocks_of(docs), "v").collect()}
    assert (out[1]["title"], out[1]["path"], out[1]["error"]) == ("Big Title", "big-title.mp3", None) and out[1]["n_chunks"] > 1
    assert (out[2]["error"], out[2]["code"], out[2]["path"]) == ("extraction", 6, None)


def test_the_newest_response_wins(spark):
    url = "https://a.org"
    asked = spark.createDataFrame([(url,)], "url string")
    rows = asked.select(landing.url_key(F.col("url")).alias("key")).crossJoin(spark.createDataFrame([(1, b"old"), (2, b"b"), (2, b"a"), (3, None)], "fetched_at int, body binary"))
    cache = rows.select("key", F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status"), F.lit("").alias("content_type"), "body", "fetched_at")
    got = landing.cached(asked, cache).collect()
    assert len(got) == 1 and bytes(got[0]["body"]) in (b"a", b"b")


def test_long_documents_are_stitched_a_piece_at_a_time(spark):
    import resource

    def engine(text):  # 30 MB a piece
        return O.wav(text.encode()[:2] * 15_000_000)

    texts = spark.createDataFrame([(str(i), f"{i:02d}") for i in range(40)], "key string, text string").coalesce(1)
    audio = O.synthesize(texts, engine, pack=True)
    pieces = audio.select((F.col("key").cast("long") % 2).alias("doc_id"), F.col("key").cast("int").alias("chunk_idx"), "audio", F.lit(100).alias("pause_after_ms"))

    def peak(batches):  # of the worker that made these rows
        for b in batches:
            yield b.append_column("mb", pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * b.num_rows, pa.int64()))

    out = D.stitch(pieces, audio=False).mapInArrow(peak, "doc_id long, seconds double, mb long").collect()
    assert {r["doc_id"]: r["seconds"] for r in out} == {d: pytest.approx(20 * (15_000_000 / O.RATE + 0.1)) for d in (0, 1)}
    assert all(r["mb"] < 500 for r in out)


def test_packed_pieces_give_the_same_wav(spark):
    rng = np.random.default_rng(5)
    rows = [(d, i, D.from_samples(rng.uniform(-1, 1, 500 + 100 * i)), 50 * i) for d in (1, 2, 3) for i in (2, 0, 1)]
    assert all(O.unpacked(O.packed(r[2])) == r[2] == O.unpacked(r[2]) for r in rows)
    kind = "doc_id long, chunk_idx int, audio binary, pause_after_ms int"
    plain = D.stitch(spark.createDataFrame(rows, kind)).collect()
    sent = D.stitch(spark.createDataFrame([(a, b, O.packed(c), p) for a, b, c, p in rows], kind)).collect()
    assert sorted(plain) == sorted(sent) and len(plain) == 3
    for r in plain:
        with wave.open(io.BytesIO(bytes(r["audio"]))) as w:
            assert r["seconds"] == w.getnframes() / O.RATE == (500 + 600 + 1200 + 700 + 2400) / O.RATE
            frames = w.readframes(w.getnframes())
        assert frames == b"".join(a[44:] + b"\0\0" * (24 * p) for _, _, a, p in sorted(x for x in rows if x[0] == r["doc_id"]))
