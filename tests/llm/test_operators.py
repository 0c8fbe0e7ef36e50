"""The operators on small tables with nulls, empty and repeated rows, extra columns, and no rows at all."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightsieve.llm import chat, decontamination, near_dedup, neighbours, packing, suffix_dedup, token_files, toxicity, url_filter, warc

RNG = random.Random(3)
WORDS = [f"w{k}" for k in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE, SHARED = prose(60), prose(150)
TEXTS = [None, "", " ", "one", "One", BASE, BASE, BASE.replace("w1", "w2", 1), prose(90) + " " + SHARED, SHARED + " " + prose(20), "ab" * 500, prose(3000), "x", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 2}", 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, rep string, n long").repartition(3)


def sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    s = sets(TEXTS, width)
    group = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, width=width, percent=percent).collect()}
    assert got == {k: (len(s[k]), group[k], group[k] == k) for k in range(len(s))}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1000, 1])
def test_remove_repeats(docs, crowd):
    raw = [(t or "").encode() for t in TEXTS]
    starts = [b[i:i + 400] for b in raw for i in range(len(b) - 399)]
    seen = {}
    for s in starts:
        seen[s] = seen.get(s, 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, crowd=crowd).collect()}
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert r.kept_bytes == kept
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_a_passage_that_thousands_share(spark):
    """One anchor with thousands of contexts, split or not, and a text that is read in stretches."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(80)
    texts = [f"{line(rng.randrange(1, 30))} {shared} {line(rng.randrange(1, 30))}" for _ in range(1500)]
    texts += [shared[:500] + word(), line(30) + shared[3:460], line(200) + shared[100:]]
    raw = [t.encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 399):
            seen[b[i:i + 400]] = seen.get(b[i:i + 400], 0) + 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for crowd in (200, 10**6):
        got = {r.doc_id: r.kept_bytes for r in suffix_dedup.remove_repeats(df, crowd=crowd).collect()}
        for k, b in enumerate(raw):
            gone = bytearray(len(b))
            for i in range(len(b) - 399):
                if seen[b[i:i + 400]] > 1:
                    gone[i:i + 400] = b"\1" * 400
            assert got[k] == bytes(x for x, g in zip(b, gone) if not g)


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rng = random.Random(9)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    whole = text[:3000] + text[1000:1900] + text[3000:]
    batch = pa.RecordBatch.from_pydict({"id": [4], "text": [whole]})
    rows = [r for b in suffix_dedup._anchor_rows(batch, 400) for r in b.to_pylist()]
    starts = sorted(s for r in rows for s in range(r["start"], r["start"] + r["count"]))
    assert starts == list(range(len(whole) - 399))


def test_contaminated(spark, docs):
    items = spark.createDataFrame([(1, SHARED), (2, "one"), (3, None), (4, ""), (None, "x"), (5, prose(40))], "item_id long, text string")
    want = set()
    for i, item in ((1, SHARED), (2, "one")):
        s = sets([item], 5)[0]
        want |= {(k, i, len(s), len(s & d)) for k, d in enumerate(sets(TEXTS, 5)) if 100 * len(s & d) >= 80 * len(s)}
    got = decontamination.contaminated(docs, items)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 4
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


def test_toxicity(spark):
    rows = [(k, (prose(30) + (" vile rot" if k % 3 == 0 else "")), int(k % 3 == 0)) for k in range(90)] + [(90, None, 0), (91, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df)
    got = {r.doc_id: r for r in toxicity.score_texts(df.select("doc_id", "text", F.lit(1).alias("score")), model).collect()}
    assert all((got[k].score >= 0.5) == (k % 3 == 0) for k in range(90)) and got[0].passages and not got[1].passages
    assert 0 <= got[90].score < 0.5 and 0 <= got[91].score < 0.5
    assert toxicity.score_texts(df.limit(0), model).count() == 0
    assert toxicity.fit(df.where("label = 0")).chances == [0.0]
    assert toxicity.with_scores(df, model).columns == ["doc_id", "text", "label", "score", "passages"]


def test_tokens_packed_and_written(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    placed = packing.pack(docs, path, 2, size=64, keep_ids=True).collect()
    flat = {}
    for r in placed:
        ids = [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == plain[r.doc_id][r.start:r.start + r.length]
        flat.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in placed) == sum(map(len, plain))
    for parts in flat.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    whole = packing.sequences(packing.pack(docs, path, 2, size=64, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(map(len, plain))
    folder, manifest = token_files.write_ids(docs, path, 2, segment_ids=500)
    rows = sorted(token_files.read_ids(folder, manifest).collect())
    assert [r.n_tokens for r in rows] == [len(p) for p in plain]
    assert [r.start for r in rows] == [sum(map(len, plain[:k])) for k in range(len(plain))]
    folder, manifest = token_files.write_ids(docs.limit(0), path, 2)
    assert token_files.read_ids(folder, manifest).count() == packing.pack(docs.limit(0), path, 2).count() == 0


def test_neighbours(spark):
    rows = [(k, [float((k * 7 + j * j) % 11 - 5) for j in range(4)]) for k in range(60)]
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0, None, 1.0, 1.0]), (63, [float("nan")] * 4), (64, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=13, block_rows=2).collect()
    want = []
    good = [(i, v) for i, v in rows[:60] if any(v)]
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>é[INST]"), (1, 0, "user", None), (2, 0, None, "a|>b"), (None, 3, "assistant", "\\<"), (1, 1, "assistant", "</s>é[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_conversations(chat.written(chat.format_conversations(df))).collect()}
    told = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    twice = [("user", ""), ("assistant", "</s>é[INST]"), ("assistant", "</s>é[INST]")]
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, told(twice), 22)
    assert (got[2].turns_sha256, got[2].loss_chars) == (told([("", "a|>b")]), 0) and got[None].loss_chars == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "x"), (3, None, "x"), (9, "u\n", None), (8, "u", ""), (7, "é", "y" * 9000), (None, "n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, files = warc.write_archives(df, file_bytes=200)
    got = {r.page_id: r for r in warc.read_archives(folder, files, split_bytes=50, payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        3: ("response", None), 5: ("revisit", 3), None: ("revisit", 3), 8: ("response", None), 9: ("revisit", 8), 7: ("response", None)}
    assert got[5].payload_bytes == 1 and got[7].payload == b"y" * 9000 and got[7].url == "é" and got[9].url == "u\n" and got[3].url is None
    folder, files = warc.write_archives(df, min_bytes=2)
    assert warc.read_archives(folder, files).where("record_type = 'revisit'").count() == 0
    folder, files = warc.write_archives(df.limit(0))
    assert warc.read_archives(folder, files).count() == 0


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls = {1: "http://A.Example.NET/en/1?x", 2: "x://example.net/enx", 3: "http://b.example.com/de/", 4: "http://notexample.com/de/1", 5: None, 6: "no url",
            7: "http://o.org/fr/2#a", 8: "http://net/x"}
    urls |= {100 + k: f"http://bad.info/spam/{k}" for k in range(40)} | {200 + k: f"http://bad.info/post/a{chr(97 + k)}/x" for k in range(25)}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("n", F.lit(0))
    labels = spark.createDataFrame([(100 + k, 1) for k in range(30)] + [(200 + k, 0) for k in range(20)] + [(1, 0), (None, 1), (3, None)], "page_id long, bad int")
    df = url_filter.judge(pages, labels, rules)
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(urls)
    assert {k: (got[k].rule, got[k].verdict) for k in range(1, 9)} == {
        1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
        7: ("org/fr/", "allow"), 8: ("net/", "block")}
    assert (got[1].host, got[1].path, got[5].host, got[6].path) == ("a.example.net", "/en/1", "", "")
    assert all(got[k].verdict == "block" for k in range(100, 140)) and all(got[k].verdict == "allow" for k in range(200, 225))
    assert "Python" not in df._jdf.queryExecution().toString()
    assert url_filter.judge(pages.limit(0), labels, rules).count() == 0


def test_url_filter_keeps_branches_of_opposite_purity(spark):
    urls = {k: f"http://one.info/{'casino' if k < 100 else 'news'}/{k % 100}" for k in range(200)}  # the same numbers below both
    urls |= {200 + k: f"http://flat.info/{'poker' if k < 60 else 'about'}?{k}" for k in range(120)}  # no children
    urls |= {400 + k: f"http://two.info/{lang}/{('docs', 'help', 'shop')[k % 3]}/{k}" for k, lang in enumerate(("en", "de", "fr") * 20)}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    bad = {k: int(k < 100 or 200 <= k < 260) for k in range(320)} | {400 + k: 0 for k in range(60)}
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert got == {k: "block" if bad[k] else "allow" for k in urls}
    paths = [(f"/{lang}/{part}/{k}", 1 if lang == "xx" else 0) for lang in ("en", "de", "fr", "xx") for part in ("docs", "help", "shop") for k in range(9)]
    rows = spark.createDataFrame([("h", p, b) for p, b in paths] + [("h", "/top", None), ("only", "/a/b/1", None)], "host string, path string, bad int")
    placed = {(r.host, *r.parts): r.template for r in url_filter.templates(rows).collect()}
    assert placed["h", "en", "docs", "3"] == placed["h", "fr", "docs", "4"] == "/*/docs/*" and placed["h", "xx", "docs", "3"] == "/xx/docs/*"
    assert placed["h", "top"] == "/top" and placed["only", "a", "b", "1"] == "/a/b/*"


def test_url_filter_reads_deep_paths(spark):
    urls = {k: f"http://deep.info/a/b/c/d/e/{'shop' if k < 40 else 'blog'}/{k % 40}" for k in range(80)} | {80: "http://deep.info/" + "x/" * 300 + "9"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert got == {k: "block" if k < 40 else "allow" for k in urls}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*TEXTS, prose(30) + " vile rot"])] + [(None, None, None, None, None), (50 + 5, prose(30), None, None, None)]
    rows += [(100 + k, prose(30) + (" vile rot" if k % 3 == 0 else ""), "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        counts.append(left.count())
        if name != "packing":
            assert left.schema == docs.schema
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert counts[0] == len(rows) - 21 and counts[1] == counts[0] - 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
