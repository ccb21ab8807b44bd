"""The queries over whole tables, and every stage of the pipeline, against plain Python."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import bpe, licenses, mixing, quality
from lectern.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "th", "h", "sid", "n", "gone", "j", "size", "target", "row", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES[5:])


def rows():
    rng = random.Random(21)
    lexicon = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(900)]
    line = lambda a, b: " ".join(rng.choices(lexicon, k=rng.randrange(a, b)))
    shared = "\n".join(line(15, 20) for _ in range(4))
    texts = ["\n".join(line(8, 30) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts += [f"{line(9, 12)}\n{shared}\n{line(30, 40)}" for _ in range(5)]
    base = line(150, 160).split()
    for _ in range(8):
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(lexicon)
        texts.append(" ".join(w))
    texts += [texts[3]] * 6 + [" ".join(base)] * 2
    texts += [None, "", " \n ", "too few words", "### $$$ ***\n" * 40, "spam and spam " * 60, "Released under the MIT License.", "\n".join(line(5, 8) for _ in range(6000))]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4]) for i, t in enumerate(texts)]
    out += [(5, texts[5], "en", "s1"), (None, texts[7], "en", "s2"), (8, "a text of its own under a number that is in use " + line(20, 30), None, "s2")]
    return [(*r, len(r[1] or ""), *["x"] * 10) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(bool(t) and "###" not in t and "spam" not in t), 0) for i, t, *_ in data if i is not None][:90]
    spark.createDataFrame(labels + [(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def repeats(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def left_by_line_dedup(docs):
    """Texts after the deletion of later copies of runs of 50 words or more, by (doc_id, place in order)."""
    seq = [[(j, x, len(WORD.findall(x))) for j, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in docs]
    first, out = {}, []
    for d, lines in enumerate(seq):
        gone = set()
        for a in range(len(lines)):
            part, n = [], 0
            for b in range(a, len(lines)):
                part.append(lines[b][1])
                n += lines[b][2]
                if n >= 50:  # the shortest run from here is enough: longer ones hold it
                    if first.setdefault(tuple(part), (d, a)) != (d, a):
                        gone.update(range(lines[a][0], lines[b][0] + 1))
                    break
        # runs that end here and begin as late as they can
        for b in range(len(lines)):
            part, n = [], 0
            for a in range(b, -1, -1):
                part.insert(0, lines[a][1])
                n += lines[a][2]
                if n >= 50:
                    if first.setdefault(("end", *part), (d, b)) != (d, b):
                        gone.update(range(lines[a][0], lines[b][0] + 1))
                    break
        out.append("\n".join(x for j, x in enumerate((docs[d][1] or "").split("\n")) if j not in gone) if gone else docs[d][1])
    return out


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_every_stage_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, at = docs.columns, {}
    forest = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        before = at.get("docs", docs.collect())
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        assert name == "bpe_tokens" or docs.columns == names
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
        if name == "quality_rules":
            want = []
            for r in before:
                words = WORD.findall(r["text"] or "")
                counts, x = quality.statistics((r["text"] or "").encode())
                assert counts[0] == len(words) and counts[4] == repeats(words)
                if len(words) >= 10 and 100 * repeats(words) <= 20 * len(words) and forest.score(np.array([x]))[0] >= quality.KEEP:
                    want.append(key(r))
            assert sorted(want) == sorted(map(key, after)) and 60 < len(want) < len(before)
        elif name == "line_dedup":
            # Order of copies: null id, then id, then text hash; only equal texts share an id here, but for one.
            order = sorted({key(r): r for r in before}.values(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
            left = dict(zip(map(key, order), left_by_line_dedup([(r["doc_id"], r["text"]) for r in order]), strict=True))
            want = collections.Counter((r["doc_id"], left[key(r)]) for r in before if left[key(r)] == r["text"] or WORD.search(left[key(r)] or ""))
            assert collections.Counter((r["doc_id"], r["text"]) for r in after) == want and any(left[key(r)] != r["text"] for r in before)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "ngram_jaccard":
            sets = [shingles(r["text"]) for r in before]
            root = list(range(len(before)))
            find = lambda x: x if root[x] == x else find(root[x])
            for a in range(len(sets)):
                for b in range(a):
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        root[find(a)] = find(b)
            groups = collections.defaultdict(list)
            for i, r in enumerate(before):
                groups[find(i)].append(r)
            kept = collections.Counter(key(r) for r in after)
            assert len(after) == len(groups) < len(before)
            for g in groups.values():
                ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
                stays = [k for k in {key(r) for r in g} if kept[k]]
                assert len(stays) == 1 and (not ids or stays[0][1] == min(ids) and not stays[0][0])
        elif name == "mix_sources":
            sizes, taken, most = collections.Counter(), collections.Counter(), 0
            for r in before:
                sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
                most = max(most, len(WORD.findall(r["text"] or "")))
            for r in after:
                taken[r["source"]] += len(WORD.findall(r["text"] or ""))
            goal = mixing.targets(list(sizes.items()))
            assert all(abs(taken[s] - goal[s]) <= most for s in sizes)
            times, there = collections.Counter(map(key, after)), collections.Counter(map(key, before))
            assert set(times) <= set(there) and all(n <= 2 * there[k] for k, n in times.items())
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(bpe.default_vocabulary())
            want = collections.Counter()
            for r in before:
                ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
                want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
            assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want
        at["docs"] = after
    assert corpus_pipeline.run(spark, folder).count() == len(at["docs"])


def test_queries_return_their_contracts(spark, folder):
    data = rows()
    out = {k: QUERIES[k](spark, folder).collect() for k in ("op3_hilbert_shards", "op4_bpe_chunks", "op5_line_dedup", "op6_quality_rules", "op7_mix_sources", "op8_license_scan", "op10_jaccard_join")}
    assert all(len(v) == len(data) for k, v in out.items() if k != "op8_license_scan")
    shards = collections.defaultdict(list)
    for r in out["op3_hilbert_shards"]:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append((r["slot"], r["curve"]))
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    order = [c for s in range(16) for _, c in sorted(shards[s])]
    assert order == sorted(order) and all([x for x, _ in sorted(v)] == list(range(len(v))) for v in shards.values())
    sizes = collections.Counter()
    for _, t, _, s, *_ in data:
        sizes[s] += len(WORD.findall(t or ""))
    goal = mixing.targets(list(sizes.items()))
    for r in out["op7_mix_sources"]:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
    assert [(r["license_id"]) for r in out["op8_license_scan"]] == ["mit"] and set(licenses.TEMPLATES) >= {"mit"}
    texts = collections.defaultdict(list)
    for i, t, *_ in data:
        texts[i].append(t)
    for r in out["op10_jaccard_join"]:
        assert r["n_shingles"] in {len(shingles(t)) for t in texts[r["doc_id"]]}
    for r in out["op6_quality_rules"]:
        assert r["n_words"] in {len(WORD.findall(t or "")) for t in texts[r["doc_id"]]} and not (r["kept"] and r["base_failed"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_memory_of_their_workers_small(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.bpe_tokens(spark, docs, folder)._jdf.queryExecution().analyzed().toString()
    assert "ids_sha256" in plan and not re.search(r"\bdecoded#", plan)  # texts don't travel back
    tables = mixing._plan(docs)[1]
    assert "RDD" not in tables._jdf.queryExecution().analyzed().toString()  # no second kind of Python workers
    assert {r["source"] for r in tables.collect()} == {"s1", "s2", None}
    code = "import sys, corpus_pipeline; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(corpus_pipeline.__file__)).returncode == 0
