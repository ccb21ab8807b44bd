"""Corpus operators against brute force, with nulls, empties, repeats, clashing columns and empty tables."""

import base64
import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard, langid, licenses, linededup, media, mixing, quality, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, n int, sid string, target string, rank string"


def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))
    base = [word() for _ in range(60)]
    out = []
    for i in range(90):  # more near copies than a region joins directly
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = word()
        out.append(" ".join(w))
    for _ in range(30):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        out.append("\n".join(lines))
    shared = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
    out += [f"{word()} start\n\n{shared}\n{word()}", f"{shared}\nother {word()}", out[100], out[100], out[100]]
    out += [None, "", " \t\n", "one", "one two", "ONE two", "é ü ñ", "x" * 50_000, "spam " * 400, "Released under the MIT License.", "\n\n\n", "A  b c\x85d <|endoftext|> e"]
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], 0, 1, "x", 2, "y", "z", None) for i, t in enumerate(out)]


ROWS = rows()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + [ROWS[3], (None, "null id", "en", "s1", *ROWS[0][4:])], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media(spark, docs, empty, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    out = media.op1_media_sequences(spark, path).collect()
    assert len(out) == len(ROWS) + 2
    for r in out:
        raw = TEXT.get(r["doc_id"], "null id").encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    items = media.parse_items('<p>a <b>b</b></p><figure><img src="x"><figcaption>cap</figcaption></figure><p>c')
    assert [(i["pos"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [(0, "text", "a b", None, None), (1, "media", None, "x", "cap"), (2, "text", "c", None, None)]
    assert media.parse_items(None) == []
    assert media.described(media.store(empty.select(media.padded(F.col("text")).alias("payload")))).count() == 0


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "dup", "dup", "dup", "é" * 1000, "x" * 200_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, 1) for i, h in enumerate(html)] + [(3, None, "dup", 1), (None, "u", "dup", 1)], "page_id long, url string, html string, digest int")
    warc.write_archives(pages, f"{tmp_path}/a", records_per_archive=3)
    out = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert len(out) == len(html) + 2 and all(r["valid"] for r in out)
    last = {h or "": max(i for i, x in enumerate(html) if (x or "") == (h or "")) for h in html}
    for r in out:
        h = "dup" if r["page_id"] is None else html[r["page_id"]] or ""
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last[h] else ("revisit", last[h]))
    one = warc.record(1, None, b"abc", None)
    with pytest.raises(ValueError):
        list(warc.members(one[:-9]))
    warc.write_archives(pages.limit(0), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_shards(spark, docs, empty):
    out = sharding.shard(docs).collect()
    n = collections.Counter(r["shard"] for r in out)
    assert sum(n.values()) == len(ROWS) + 2 and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(16))
    for s in n:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))
    for r in out:
        raw = TEXT.get(r["doc_id"], "null id").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(empty).count() == 0
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = grid[np.argsort(sharding.hilbert_index(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # a curve: neighbours touch


def test_shard_files_are_skipped_by_their_bounds(spark, docs, empty, tmp_path):
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    path, every = str(tmp_path / "full"), docs.collect()
    sharding.write_shards(docs, path)
    assert plain(sharding.read_shards(spark, path).collect()) == plain(every) and sharding.read_shards(spark, path).columns == docs.columns
    n = [r["n_rows"] for r in spark.read.parquet(f"{path}/bounds").collect()]
    assert len(n) == 16 and sum(n) == len(every) and max(n) - min(n) <= 2  # one row of the fixture comes twice
    size = lambda r: len((r["text"] or "").encode()) + 1
    for source, lang, least, most in [("s1", "en", 0, None), (None, "de", 0, 400), ("s2", None, 100, 300), ("s0", sharding.ANY, 0, 20), ("none such", "en", 0, None)]:
        want = [r for r in every if r["source"] == source and (lang is sharding.ANY or r["lang"] == lang) and size(r) >= least and (most is None or size(r) <= most)]
        assert plain(sharding.read_shards(spark, path, source, lang, least, most).collect()) == plain(want)
        assert len(sharding.shards_for(spark, path, source, lang, least, most)) <= 8
    plan = sharding.read_shards(spark, path, "s1", "en")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(__shard" in plan or "__shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    sharding.write_shards(empty, str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), "s1").count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.encode(docs).collect():
        ids = tok.encode(TEXT.get(r["doc_id"], "null id"), add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        text = tok.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def test_bpe_idle_workers_hold_no_vocabulary(spark, docs):
    bpe.encode(docs).collect()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._CODECS)], pa.int64())], ["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= bpe.BATCH_ROWS


def test_line_dedup(docs, empty):
    order = sorted(TEXT)
    seq = {d: [(j, x, len(WORD.findall(x))) for j, x in enumerate(TEXT[d].split("\n")) if WORD.search(x)] for d in order}
    seen, gone = set(), collections.defaultdict(set)
    for d in order:
        for a in range(len(seq[d])):
            for b in range(a, len(seq[d])):
                part = seq[d][a : b + 1]
                if sum(w for *_, w in part) >= 50:
                    key = tuple(x for _, x, _ in part)
                    if key in seen:
                        gone[d].update(range(part[0][0], part[-1][0] + 1))
                    seen.add(key)
    out = by_id(linededup.delete_lines(docs))
    for d in order:
        assert set(out[d]["__line_gone"] or []) == gone[d]
        assert (out[d]["text"] or "") == "\n".join(x for j, x in enumerate(TEXT[d].split("\n")) if j not in gone[d])
    assert any(gone.values()) and linededup.delete_lines(empty).count() == 0


def test_line_dedup_of_many_overlapping_runs(spark):
    lines = [f"w{i % 700} again" for i in range(20_000)]  # every run of 25 lines comes again 700 lines later
    text = "\n".join(lines)
    out = by_id(linededup.delete_lines(spark.createDataFrame([(1, text), (2, text), (3, "alone " * 60)], "doc_id long, text string")))
    assert out[1]["__line_gone"] == list(range(700, 20_000)) and out[1]["text"] == "\n".join(lines[:700])
    assert out[2]["__line_gone"] == list(range(20_000)) and out[2]["text"] == "" and out[3]["__line_gone"] is None


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i != 128 and i < 121), 0) for i in range(len(ROWS))] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, labels)
    out = by_id(quality.judge(docs, forest))
    for d, text in TEXT.items():
        w = WORD.findall(text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = out[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.keep_good(docs, None).where("doc_id = 0").count() == 1
    assert quality.judge(empty, forest).count() == 0 and quality.fit(docs, labels.limit(0)) is None


def test_trees_are_monotone_and_right():
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.2 * rng.random(800) < 0.6).astype(float)
    forest = quality.train(x, y)
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.9
    for j in (2, 3, 4, 5):
        line = np.repeat(x[:50], 20, 0)
        line[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(forest.score(line).reshape(50, 20), axis=1) <= 1e-12).all()


def test_mixing(docs, empty):
    narrow, sources, _ = mixing.plan(docs)
    s = {r["source"]: r for r in sources.collect()}
    total = sum(len(WORD.findall(TEXT.get(r["doc_id"], "null id"))) for r in docs.select("doc_id").collect())
    assert sum(r["source_size"] for r in s.values()) == total and abs(sum(r["target"] for r in s.values()) - 1.5 * total) < 1e-6
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in s.values())
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        assert len(r) == len(SCHEMA.split(","))
        taken[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(len(WORD.findall(t)) for t in TEXT.values())
    assert all(abs(taken[k] - r["target"]) <= longest for k, r in s.items())
    assert mixing.mix(empty).count() == 0
    assert mixing.targets([("a", 10), ("b", 100), (None, 100)]) == {"a": 20.0, "b": 295 * 2 / 3, None: 295 / 3}


def test_licenses(docs, empty):
    want = set()
    for d, text in TEXT.items():
        for j, line in enumerate(text.split("\n")):
            g = licenses.bigrams_of(line)
            best = max(((2 * len(g & t) / (len(g) + len(t)), name) for name, t in ((n, licenses.bigrams_of(x)) for n, x in sorted(licenses.TEMPLATES.items(), reverse=True))), key=lambda p: p[0])
            if g and best[0] >= 0.75:
                want.add((d, j, best[1]))
    assert {(r["doc_id"], r["line_no"], r["license_id"]) for r in licenses.scan(docs).collect()} == want and want
    assert licenses.scan(empty).count() == 0


def test_wrapped_and_embedded_notices(spark):
    wrap = lambda name, width, lead="": "\n".join(textwrap.wrap(licenses.TEMPLATES[name], width, initial_indent=lead, subsequent_indent=lead))
    texts = {
        1: "Copyright 2020 A. Person\n\n" + wrap("mit-grant", 78) + "\n\nThe end.",
        2: "/*\r\n" + wrap("isc", 60, " * ").replace("\n", "\r\n") + "\r\n */\r\nint main(void)",
        3: wrap("gpl-3.0-header", 70, "# ") + "\nimport os",
        4: "The tool was written in a long winter and is Released under the MIT License. It has many users and some of them write letters.",
        5: "The code of this large project is released under the MIT License, while all of its texts are licensed under CC BY 4.0. More follows here.",
        6: "nothing here\n" + wrap("apache-2.0-header", 72) + "\nmore",
        7: "the mit students wrote under the licensed software and copyright notices of other people",
        8: "Released under the MIT License.\nplain words after it",
        9: wrap("mpl-2.0", 30),
        10: "\n".join([wrap("bsd-3-clause", 40), "some other words", wrap("bsd-3-clause", 50)]),
    }
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["line_no"], r["license_id"]))
        assert 0.75 <= r["dice"] <= 1
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(2, "mit-grant")], 2: [(1, "isc")], 3: [(0, "gpl-3.0-header")], 4: [(0, "mit")], 5: [(0, "cc-by-4.0"), (0, "mit")],
        6: [(1, "apache-2.0"), (1, "apache-2.0-header")], 8: [(0, "mit")], 9: [(0, "mpl-2.0")], 10: [(0, "bsd-3-clause"), (5, "bsd-3-clause")],
    }


def test_license_windows_against_brute_force(spark):
    """Every template with a window that reaches the threshold in a text reports, unless a notice of more evidence covers it."""
    rng = random.Random(5)
    pool = [w for t in ("mit", "bsd-notice", "gpl-2.0", "gpl-3.0", "cc-by-4.0") for w in re.sub("[^a-z0-9]+", " ", licenses.TEMPLATES[t].lower()).split()]
    texts = {}
    for i in range(150):
        words = [rng.choice(pool) for _ in range(rng.randrange(5, 25))]
        notice = licenses.TEMPLATES[rng.choice(["mit", "gpl-3.0", "cc-by-4.0"])].split()
        if i % 3:
            at = rng.randrange(len(words))
            words[at:at] = [w for w in notice if rng.random() < 0.95]
        texts[i] = "".join(w + rng.choice(" \n   ") for w in words)
    want = set()
    for i, text in texts.items():
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for template in licenses.TEMPLATES.values():
            t, far = licenses.bigrams_of(template), licenses.reach(template)
            if any(2 * len((g := set(grams[a:b])) & t) >= 0.75 * (len(g) + len(t)) for a in range(len(grams)) for b in range(a + 1, min(len(grams), a + far) + 1)):
                want.add(i)
    out = licenses.scan(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == want and 50 < len(want) < 150


def test_language(docs, empty):
    words = {"en": "the cat sat on the mat and then ran away from the house " * 40, "de": "die katze lag auf der matte und lief dann schnell aus dem haus " * 40}
    names, score = langid.predict(["the house and the cat".encode(), "der matte und die katze".encode(), b"123", None], words)
    assert names == ["en", "de", "und", "und"] and score[2] == 0 and (score[:2] > 0).all()
    text, ref = langid.normalise("the dog ran from the mat"), langid.normalise(words["en"])
    phrases, at = 0, 0
    while at < len(text):
        n = next(k for k in range(len(text) - at, -1, -1) if k == 0 or text[at : at + k] in ref)
        phrases, at = phrases + 1, at + max(n, 1)
    _, codes, automata = langid.models({"en": ref})
    c, _ = langid.encode(text.encode(), codes)
    # A character the reference lacks ends a phrase and starts none.
    assert abs(int(automata[0].phrases(c[:, None], np.array([len(c)]))[0]) - phrases) <= 1
    out = by_id(langid.identify(docs, langid.reference_texts(docs)))
    assert out[120 + 5]["lang_pred"] == "und" and len(out) == len(ROWS) + 1
    assert out[0]["held_out"] == (zlib.crc32(b"0") % 5 == 0)
    assert langid.identify(empty, langid.reference_texts(empty)).count() == 0


def test_language_of_large_scripts():
    """Scripts with more letters than a byte holds, beside others, against a longest match by string search."""
    rng = random.Random(3)
    letters = {"zh": [chr(0x4E00 + i) for i in range(600)], "zh-hant": [chr(0x4E00 + i) for i in range(500)] + [chr(0x7000 + i) for i in range(100)], "ko": [chr(0xAC00 + i) for i in range(400)], "el": list("αβγδεζηθικλμνξοπρστυφχψω"), "en": list("etaoinshrdlu")}
    lexicon = {k: ["".join(rng.choices(v, k=rng.randrange(1, 4))) for _ in range(500)] for k, v in letters.items()}
    text = lambda k, n: " ".join(rng.choices(lexicon[k], k=n))
    reference = {k: text(k, 2500) for k in letters}
    langs, codes, automata = langid.models(reference)
    assert len({int(codes[ord(c)]) for v in reference.values() for c in v} - {0}) == len(set("".join(reference.values())))
    samples = {k: text(k, 60)[: langid.STRIDE] for k in letters}
    for k, sample in samples.items():
        c, _ = langid.encode(sample.encode(), codes)
        for lang, automaton in zip(langs, automata, strict=True):
            want, held = 1, ""
            for x in sample.rstrip():
                if held + x in reference[lang]:
                    held += x
                else:
                    want, held = want + 1, x if x in reference[lang] else ""
            assert automaton.phrases(c[:, None], np.array([len(c)]))[0] == want, (k, lang)
    names, _ = langid.predict([s.encode() for s in samples.values()], reference)
    assert names == list(samples)


def test_jaccard(docs, empty):
    sets = {}
    for d, text in TEXT.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = jaccard.group(docs).collect()
    assert len(out) == len(ROWS) + 2
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r
    kept = collections.Counter(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert set(kept) == {find(d) for d in sets} | {None}
    assert jaccard.group(empty).count() == 0


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 20)), dtype=np.uint64)]))
        if len(b) and jaccard.linked(len(a), len(b), len(np.intersect1d(a, b))):
            assert jaccard.may_link(len(a), jaccard.parity_bits(a), len(b), jaccard.parity_bits(b))


def test_captions_stay_with_their_figures(spark):
    caps = lambda html: [i["caption"] for i in media.parse_items(html) if i["kind"] == "media"]
    assert caps('<figure><img src="a"><figcaption>one</figcaption></figure><figcaption>stray</figcaption>') == ["one"]
    assert caps('<figure><img src="a"><figure><img src="b"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>') == ["outer", "inner"]
    assert caps('<img src="a" alt="x"><figure><figcaption>late</figcaption><img src="b">') == ["x", "late"]
    pages = spark.createDataFrame([(1, '<p>t</p><img src="sha256:%s"><p>u</p><img src="other">' % ("a" * 64)), (2, None)], "page long, html string")
    stored = spark.createDataFrame([("a" * 64, 7)], "digest string, payload_bytes long")
    out = media.resolve(media.interleave(pages, "page", "html"), stored).orderBy("pos").collect()
    assert [(r["kind"], r["payload_bytes"]) for r in out] == [("text", None), ("media", 7), ("text", None), ("media", None)]


def test_media_table_holds_each_payload_once(spark, tmp_path):
    rows = [(1, "same", 1, 1), (2, "same", 2, 2), (None, "same", 3, 3), (3, None, 4, 4), (4, "", 5, 5), (5, "x" * 3_000_000, 6, 6), (None, "only null", 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, payload int")
    found = media.media_table(docs, "doc_id", media.padded(F.col("text")))
    assert found.count() == 4
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op1_media_sequences(spark, str(tmp_path)).collect():
        raw = next(t or "" for d, t, *_ in rows if d == r["doc_id"] and (d is not None or len((t or "").encode()) == r["n_bytes"])).encode()
        p = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        wav = media.to_wav(p)
        assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"], r["feature"]) == (hashlib.sha256(p).hexdigest(), len(wav), hashlib.sha256(wav).hexdigest(), media.features(np.frombuffer(p, np.uint8)))
        assert (r["pos"], r["caption"]) == (1, f"{len(raw)} bytes")


def test_equal_rows_do_not_overshoot_a_target(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j", "s", 0)] * 100 + [(2, "k l m", "s", 0), (3, "n o p q", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tied int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op7_mix_sources(spark, str(tmp_path)).collect()
    target = out[0]["target"]
    assert len(out) == 102 and target == 1.5 * 1007 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert abs(sum(r["taken"] for r in out) - target) <= 10
    mixed = mixing.mix(docs).collect()
    assert abs(sum(len(r["text"].split()) for r in mixed) - target) <= 10


def test_cross_parse_is_that_of_the_whole_text():
    rng = random.Random(1)
    reference = {k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(n)) for k, n in (("x", 3000), ("y", 500))}
    texts = ["", "a", reference["x"]]
    for _ in range(25):
        t, size = "", rng.choice([10, 300, 3000])
        while len(t) < size:
            a = rng.randrange(len(reference["x"]) - 700)
            t += reference["x"][a : a + rng.randrange(5, 700)] if rng.random() < 0.5 else "".join(rng.choices("abcdefghz ", k=20))
        texts.append(langid.normalise(t))
    langs, codes, automata = langid.models(reference)
    got = langid.count_phrases([langid.encode(t.encode(), codes)[0] for t in texts], automata)
    for i, t in enumerate(texts):
        for j, lang in enumerate(langs):
            want, held = int(bool(t)), ""
            for x in t:
                if held + x in reference[lang]:
                    held += x
                else:
                    want, held = want + 1, x if x in reference[lang] else ""
            assert got[i, j] == want


def test_language_held_out(spark, tmp_path):
    rng = random.Random(4)
    lexicon = {k: ["".join(rng.choices(v, k=rng.randrange(2, 7))) for _ in range(80)] for k, v in (("aa", "abcdefg"), ("bb", "defghij"), ("cc", "абвгд"))}
    rows = [(i, " ".join(rng.choices(lexicon[k], k=rng.randrange(5, 60))), k) for i in range(300) for k in [rng.choice(list(lexicon))]]
    rows += [(300, None, "aa"), (301, "12 34", "aa"), (302, "x" * 2_000_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = by_id(langid.op9_language_id(spark, str(tmp_path)))
    assert len(out) == len(rows) and (out[300]["lang_pred"], out[301]["lang_pred"]) == ("und", "und") and out[300]["score"] == 0
    held = [(out[i]["lang_pred"], k) for i, _, k in rows[:300] if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows) and len(held) > 30
    assert sum(a == b for a, b in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in out.values())


def test_one_document_of_a_group_stays_whatever_its_id(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    near = [*base[:-1], "other"]
    rows = [(None, " ".join(base), 1), (None, " ".join(near), 2), (7, "something else entirely of its own here", 3), (7, " ".join(base), 4), (9, " ".join(near), 5), (9, " ".join(near), 6), (None, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    assert sorted(r["th"] for r in jaccard.keep_one(docs).collect() if r["text"]) in ([3, 4],)
    assert jaccard.keep_one(docs).where("th >= 7").count() == 2
    same = spark.createDataFrame([(1, " ".join(base), i) for i in range(5)], "doc_id long, text string, n int")
    assert jaccard.keep_one(same).count() == 1


def test_regions_keep_every_link_and_forests_join_what_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        members = []
        for i in range(12):
            s = np.unique(np.where(rng.random(80) < rng.choice([0.0, 0.05, 0.5]), rng.integers(0, 1 << 62, 80, dtype=np.uint64), base))
            members.append(jaccard._Member(i, len(s), jaccard.shorten(jaccard.parity_bits(s))))
        root = list(range(12))
        find = lambda x: x if root[x] == x else find(root[x])
        for x, y in jaccard.spanning_forest(members):
            assert find(x.sid) != find(y.sid)
            root[find(x.sid)] = find(y.sid)
        for x in members:
            for y in members:
                assert not x.near(y) or find(x.sid) == find(y.sid)
