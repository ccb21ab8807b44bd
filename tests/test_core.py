"""Rules against plain-Python twins and literal cases; queries against their SQL is the driver's part."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import values as V
from lectern.operators import blocks as B
from lectern.operators import output as O
from lectern.operators import speech as S
from lectern.plans.queries import QUERIES
from lectern.sources import landing, pdf, web
from lectern.streaming import ingest

BLOCK = "doc_id long, pos int, kind string, text string, level int, ordinal int, page int, position double"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("ﬁnd eﬃcient", "find efficient"), ("soft­ly​", "softly"), ("a b", "a b"), ("“x” ‘y’…", "\"x\" 'y'."), ("🎉 party ☀", "party"), (" • item", "item"), ("a\nb", "a\nb"), ("", "")],
)
def test_hygiene(spark, raw, clean):
    assert one(spark, T.repair_unicode, raw) == clean


def test_values_are_code_points():
    assert [ord(c) for c in V.SPACES] == [0xA0, 0x2007, 0x2009, 0x202F, 0x2028]
    assert [ord(c) for c in V.INVISIBLE] == [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF]


@pytest.mark.parametrize(("token", "ends"), [("Dr.", False), ("etc.", False), ("Etc.", False), ("J.", False), ("U.S.", False), ("end.", True), ('end."', False), ("what?", True), ("no", False)])
def test_sentence_end(spark, token, ends):
    assert one(spark, T.ends_sentence, token) is ends
    assert S.is_sentence_end(token) is ends


def test_hyphens(spark):
    rows = [(1, 0, "representa-\ntion of self-\nattention"), (1, 1, "self-attention"), (2, 0, "a-\nb-\nc"), (3, 0, "été-\nvoilà x")]
    out = {(r["doc_id"], r["pos"]): r["text"] for r in B.repair_wraps(spark.createDataFrame(rows, "doc_id long, pos int, text string")).collect()}
    assert out[1, 0] == "representation of self-attention"
    assert out[2, 0] == "ab- c"
    assert out[3, 0] == "étévoilà x"


def test_running_artifacts(spark):
    rows = [(1, i, "paragraph", f"Page {i}", 0, None, i + 1, 0.95) for i in range(2)]
    rows += [(1, 10 + i, "paragraph", "stamp", 0, None, i + 1, 0.3) for i in range(4)]
    rows += [(1, 20 + i, "paragraph", "mid twice", 0, None, i + 1, 0.5) for i in range(2)]
    left = B.drop_running(spark.createDataFrame(rows, BLOCK)).select("text").distinct().collect()
    assert [r["text"] for r in left] == ["mid twice"]


def test_duplicates_greedy_against_twin(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(40):
        for pos in range(6):
            base = [f"w{rng.randrange(8)}" for _ in range(rng.randrange(1, 12))]
            rows.append((doc, pos, rng.choice(["paragraph", "quote", "heading"]), " ".join(base), 0, None, None, None))
    got = {(r["doc_id"], r["pos"]) for r in B.drop_duplicates(spark.createDataFrame(rows, BLOCK)).collect()}
    want = set()
    for doc in range(40):
        mine = [r for r in rows if r[0] == doc]
        gone = set()
        for a in mine:
            if a[2] == "heading":
                continue
            t = a[3].split()
            for b in mine:
                u = b[3].split()
                if b[1] in gone or b[1] == a[1] or len(u) <= len(t):
                    continue
                inside = any(u[i : i + len(t)] == t for i in range(len(u)))
                if inside or (B.ratio(t, u) >= 0.85 and len(t) / len(u) <= 0.95):
                    gone.add(a[1])
                    break
        want |= {(doc, r[1]) for r in mine if r[1] not in gone}
    assert got == want


def test_kind_policy(spark):
    kinds = ["code", "caption", "code", "paragraph", "table", "table"]
    rows = [(1, i, k, f"t{i}", 0, None, None, None) for i, k in enumerate(kinds)]
    out = [r["text"] for r in B.kind_policy(spark.createDataFrame(rows, BLOCK)).orderBy("pos").collect()]
    assert out == ["Code omitted.", "t3", "Table omitted."]


def test_lists_and_tidy(spark):
    rows = [(1, i, "list_item", f"item {i}", 0, i + 1, None, None) for i in range(13)] + [(1, 13, "paragraph", "", 0, None, None, None), (1, 14, "heading", "End", 1, None, None, None)]
    out = S.to_nodes(spark.createDataFrame(rows, BLOCK)).orderBy("seq").collect()
    assert out[0]["text"] == "A list of 13 items." and out[1]["ms"] == 500 and out[2]["text"] == "One."
    assert [r["ms"] for r in out if r["node"] == "Pause"][-1] == 1200
    assert out[-1]["node"] == "Say" and all(a["node"] != "Pause" or b["node"] != "Pause" for a, b in zip(out, out[1:], strict=False))


def test_pack():
    text = "First sentence here. Second one, by Dr. Smith, is longer. " + "clause, " * 30 + "end. Last."
    for limit in (20, 40, 80, 200):
        pieces = S.pack(text, limit)
        assert " ".join(pieces) == " ".join(text.split())
        assert all(len(p) <= limit for p in pieces)
    assert S.pack("x" * 50, 10) == ["x" * 50]
    assert S.pack("short", 10) == ["short"]


def test_status_and_markers(spark):
    assert one(spark, web.paywall_markers, '<div class="Paywall"> "isAccessibleForFree": False') == ["schema.org isAccessibleForFree=false", "paywall"]
    assert one(spark, web.paywall_markers, "") == []


def test_html_blocks():
    title, rows = web.parse_blocks("<title>T &amp; U</title><nav>x</nav><h2>Head</h2><p>a<br>b<ol><li>one<li>two</ol><div class='ad'>buy<div>now</div></div><pre>code</pre>")
    assert title == "T & U"
    assert rows == [("heading", "Head", 2, None), ("paragraph", "a b", 0, None), ("list_item", "one", 0, 1), ("list_item", "two", 0, 2), ("code", "code", 0, None)]


def test_heading_merge(spark):
    rows = [(1, 1, 0, "heading", "A long", 1, 0.10), (1, 1, 1, "heading", "title", 1, 0.13), (1, 1, 2, "heading", "Far", 1, 0.5)]
    out = pdf.merge_headings(spark.createDataFrame(rows, "doc_id long, page int, pos int, kind string, text string, level int, position double"))
    assert [r["text"] for r in out.orderBy("pos").collect()] == ["A long title", "Far"]


def test_resume_makes_no_second_call(spark, tmp_path):
    keyed = S.chunk_keys(spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "bye")], "doc_id long, text string"), "bf_emma")
    path = str(tmp_path / "cache")
    assert ingest.resume(spark, keyed, path) == 2
    assert ingest.resume(spark, keyed, path) == 0


def test_slug(spark):
    assert one(spark, O.slug, "Crème Brûlée: a_story!") == "creme-brulee-a-story"
    assert len(one(spark, O.slug, "word " * 40)) <= 80


def _expanded(text):
    """Rules 10 and 11 in plain Python."""
    text, held = re.sub(V.URL, "link", re.sub(V.EMAIL, "", text)), []
    for p in V.PROTECTED:
        text = re.sub(p, lambda m: held.append(m[0]) or f"\0{len(held) - 1}\0", text)
    for p, to in V.EXPANSIONS:
        text = re.sub(p, re.sub(r"\$(\d)", r"\\\1", to), text)
    for i, x in enumerate(held):
        text = text.replace(f"\0{i}\0", x)
    return re.sub(r"[ \t]+", " ", text).strip()


def test_expand_blocks_takes_every_block(spark, tmp_path):
    lines = {
        "Smith et al. wrote it, e.g. here, i.e. there": "Smith and others wrote it, for example here, that is there",
        "see Fig. 3 and No. 5": "see Figure 3 and Number 5",
        "salt § 4 at 20°": "salt section 4 at 20 degrees",
        "pages 2–3 of example.com/page": "pages 2 to 3 of link",
        "80% of v2.5 & more to a.b@c.org": "80 percent of v2.5 and more to",
        "nothing to change": "nothing to change",
    }
    assert {k: _expanded(k) for k in lines} == lines
    rng, parts = random.Random(2), " ".join(lines).split()
    more = [" ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(60)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(more)), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    clean = B.hygiene(spark.createDataFrame([(d, i, "paragraph", x, 0, None, None, None) for d, t in docs for i, x in enumerate(t.split("\n"))], BLOCK)).collect()
    got = [(r["doc_id"], r["pos"], r["text"]) for r in QUERIES["expand_blocks"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((r["doc_id"], r["pos"], _expanded(r["text"])) for r in clean) and len(got) == 66


def test_expand_documents_knows_ascii_addresses(spark, tmp_path):
    lines = ["Chü.iooga éanrequeç.ioale erüwort.comcns", "wrote éa.b@c.org or see a.b@c.org", "at www.münchen.de/ü end", "plain site.org here"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: r["text"] for r in QUERIES["expand_documents"](spark, str(tmp_path)).collect()}
    # As RE2 reads the SQL's patterns, and Python with its flag for ASCII.
    assert [got[i] for i in range(4)] == [re.sub(V.URL, "link", re.sub(V.EMAIL, "", x, flags=re.A), flags=re.A).replace("  ", " ").strip() for x in lines]
    assert got[0] == "Chü.iooga éanrequeç.ioale erülinkcns" and got[1] == "wrote é or see"
    rows = S.expand(spark.createDataFrame([(1, lines[0])], "id long, text string"))
    assert rows.collect()[0]["text"] == "linkoga linkale linkcns"


def test_named_references_need_their_semicolon():
    title, rows = web.parse_blocks("<title>a &amp b</title><h1>x&&&amp</h1><p>&lt;i&gt; &ampfoo; &notin; &AMP &#65; &#x42; &copy &eacute;&nosuch;</p><pre>a &lt b &amp; c</pre>")
    assert title == "a &amp b"
    assert rows == [("heading", "x&&&amp", 1, None), ("paragraph", "<i> &ampfoo; ∉ &AMP A B &copy é&nosuch;", 0, None), ("code", "a &lt b & c", 0, None)]


def test_one_response_a_key(spark):
    rows = [("u", "f", 200, "text/html", b, t) for b, t in ((b"a", 1), (b"b", 2), (b"c", 2), (b"d", 2), (b"e", 1))] + [("u", "f", 500, "text/html", b"x", 9), ("u", "f", 200, "text/html", None, 9), ("v", None, 200, None, b"a", 0)]
    best = max((b"b", b"c", b"d"), key=lambda b: hashlib.sha256(b).hexdigest())
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "url string, final_url string, status int, content_type string, body binary, t long").repartition(3, "body")
        out = landing.to_cache(df, F.col("t"))
        assert out.columns == ["key", "final_url", "status", "content_type", "body", "fetched_at"]
        assert sorted((bytes(r["body"]), r["fetched_at"]) for r in out.collect()) == sorted([(best, 2), (b"a", 0)])


def test_searches_ahead_lose_nothing(spark):
    rng = random.Random(4)
    bits = "et al.|e.g.|e. g.|E.G.,|i.e.|I. e.|etc.|cf.|vs.|v.|approx.|Fig. 3|Figs.4|No. 5|Nos.6|pp. 7|p. 8|80%|5 %|&|§ 4|20 °|±|≈|×|2 – 3|é|x|9|.|v2.5|14:05|3-5|a.pdf|www.a.b/c|WWW.x|https://q|a.com|x.ORG/y|m@x.org|{a,b}@c.de".split("|")
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain, mailed = F.col("x"), T.re_sub(F.col("x"), T.U + V.EMAIL, "")
    for p, to in V.EXPANSIONS:
        plain = T.re_sub(plain, T.U + p, to)
    held = " or ".join(f"regexp_like(x, r'{T.U + p}')" for p in V.PROTECTED)
    got = rows.select(plain.alias("a"), T.expansions(F.col("x")).alias("b"), T.re_sub(mailed, T.U + V.URL, "link").alias("c"), T.links(F.col("x")).alias("d"), (F.expr(held) & ~F.col("x").rlike(T.U + V.MAY_PROTECT)).alias("e")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] and not r["e"] for r in got)
