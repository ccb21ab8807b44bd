"""Responses, settings and merging against literal cases and plain-Python twins."""

import random

import pytest

from lectern.operators import merge as M
from lectern.sources import landing, settings


def test_decode_bytes():
    assert landing.decode_bytes("é".encode(), "no-such-charset") == "é"
    assert landing.decode_bytes(b"\x93x\x94") == "“x”"
    assert landing.decode_bytes(b"\x81\xff") == "\x81ÿ"
    assert landing.decode_bytes(b"") == ""
    assert landing.decode_bytes(None) is None


def test_cache_and_refusals(spark):
    asked = spark.createDataFrame([("https://a.org",), ("https://b.org",), ("https://b.org",), (None,)], "url string")
    rows = [("https://a.org", b"old", 1), ("https://a.org", b"new", 2), ("https://b.org", None, 3)]
    cache = spark.createDataFrame(rows, "url string, body binary, at int").selectExpr("substring(sha2(url, 256), 1, 32) key", "string(null) final_url", "int(null) status", "string(null) content_type", "body", "at fetched_at")
    got = landing.cached(asked, cache).collect()
    assert [(r["url"], bytes(r["body"]), r["status"], r["content_type"]) for r in got] == [("https://a.org", b"new", 200, "")]
    missing = landing.to_fetch(asked, cache)
    assert [r["url"] for r in missing.collect()] == ["https://b.org"]
    done = landing.fetch(missing, lambda url, plain: (url, 200 if plain else 403, "text/html", b"ok")).collect()
    assert [(r["url"], r["status"], bytes(r["body"])) for r in done] == [("https://b.org", 200, b"ok")]
    assert landing.cached(asked, cache.limit(0)).count() == 0


def test_pdf_responses(spark):
    rows = spark.createDataFrame([(1, "application/PDF", b""), (2, "text/html", b"%PDF-1.7"), (3, None, b"<html>"), (4, "text/html", None)], "id int, t string, b binary")
    assert [r["id"] for r in rows.where(landing.is_pdf(rows["t"], rows["b"])).collect()] == [1, 2]


def test_thin_articles(spark):
    pages = spark.createDataFrame([(1, "<p class='paywall'>x"), (2, "<p>x"), (3, None)], "page_id long, html string")
    blocks = spark.createDataFrame([(1, "two words"), (2, "w " * 400)], "doc_id long, text string")
    out = {r["page_id"]: (r["words"], r["thin"], r["gated"]) for r in landing.thin_articles(pages, blocks).collect()}
    assert out == {1: (2, True, True), 2: (400, False, False), 3: (0, True, False)}


def test_settings_precedence(tmp_path):
    file = tmp_path / "settings.toml"
    assert settings.load(file, env={}) == settings.DEFAULTS | {"engine_options": {}}
    file.write_text('[defaults]\naccent = "US"\nspeed = 1.5\nheader = "yes"\nother = 1\n[engines.kokoro]\nmodel = "full"\n')
    got = settings.load(file, {"speed": None, "format": "WAV"}, {"LECTERN_SPEED": " 2 ", "LECTERN_GENDER": "", "LECTERN_HEADER": "no"})
    assert got == {"engine": "kokoro", "accent": "us", "gender": "female", "voice": None, "speed": 2.0, "format": "wav", "header": True, "engine_options": {"kokoro": {"model": "full"}}}


@pytest.mark.parametrize("text", ["[defaults", "defaults = 1", "[defaults]\nspeed = 3", "[defaults]\nspeed = 'fast'", "[defaults]\naccent = 'xx'", "[defaults]\nheader = 2", "[defaults]\nengine = ' '"])
def test_settings_errors(tmp_path, text):
    file = tmp_path / "settings.toml"
    file.write_text(text)
    with pytest.raises(settings.SettingsError):
        settings.load(file, env={})


def _filled(lengths, limit):
    out, used = [], None
    for n in lengths:
        new = used is None or used + 1 + n > limit
        used = n if new else used + 1 + n
        out.append((out[-1] + 1 if new and out else 0) if new else out[-1])
    return out


def test_merge_against_twin(spark):
    rng = random.Random(3)
    rows = [(d, 2 * k, "x" * rng.choice([1, 5, 10, 30, 45]), 0) for d in range(12) for k in range(rng.choice([1, 2, 9, 25]))]
    runs = spark.createDataFrame(rows, "doc_id long, run_id int, text string, pause_after_ms int").selectExpr("*", "length(text) n_chars")
    got = {(r["doc_id"], r["run_id"]): r["chunk"] for r in M.fill(runs, 40).collect()}
    for d in range(12):
        mine = [r for r in rows if r[0] == d]
        assert [got[d, r[1]] for r in mine] == _filled([len(r[2]) for r in mine], 40)
    report = {r["doc_id"]: (r["n_chunks"], r["kept"], r["lost"]) for r in M.merge_report(runs, 40).collect()}
    for d, (n, kept, lost) in report.items():
        assert kept == n - 1 and kept + lost == sum(r[0] == d for r in rows) - 1
    assert M.merge_report(runs.limit(0), 40).count() == 0


def test_long_runs_split_by_sentence(spark):
    text = "One two. Three four! Five? " + "six " * 10 + "end. Tail."
    rows = spark.createDataFrame([(1, 0, text, len(text), 0)], "doc_id long, run_id int, text string, n_chars int, pause_after_ms int")
    parts = [r["text"] for r in M.merged_chunks(rows, 20).orderBy("part").collect()]
    assert parts == ["One two. Three four!", "Five?", "six " * 10 + "end.", "Tail."]


def test_even_strides(spark):
    for total in (1, 4, 5, 6, 13, 50):
        rows = spark.createDataFrame([(1, i) for i in range(total)], "doc_id long, run_id int")
        want = list(range(total)) if total <= 5 else [i * total // 5 for i in range(5)]
        assert sorted(r["run_id"] for r in M.evenly(rows, 5).collect()) == want
