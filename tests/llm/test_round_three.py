"""Periodic runs, Merkle manifests and SimHash near-dedup against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightsieve.llm import merkle, periodic_runs, simhash

RNG = random.Random(11)
GAP = r"[\x20\x09-\x0D]+"


def prose(n, kinds=300):
    return " ".join(f"w{RNG.randrange(kinds)}" for _ in range(n))


def plain_runs(w, least=1):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in out.items() if e - s >= least), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 12), st.integers(1, 7), st.integers(0, 40))
def test_catcher_finds_all_runs_however_words_arrive(words, period, piece, copies):
    words = words + (words[:period] * copies)[:60]
    want = plain_runs(words)
    for step in (1, piece, max(1, len(words))):
        catcher = periodic_runs.SquareCatcher()
        for at in range(0, len(words), step):
            catcher.append(np.array(words[at:at + step], np.int64))
            assert [tuple(r) for r in catcher.runs().tolist()] == plain_runs(words[:at + step])
        assert [tuple(r) for r in catcher.runs().tolist()] == want


def test_catcher_reads_long_periods_and_one_word():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 50, 3001)
    catcher = periodic_runs.SquareCatcher()
    catcher.append(np.concatenate((rng.integers(0, 50, 77), block, block, block[:5], [99], np.zeros(40000, np.int64))))
    rows = {tuple(r) for r in catcher.runs().tolist()}
    assert any(q == 3001 and s <= 77 and e >= 77 + 6007 for s, e, q in rows)
    assert (77 + 6008, 77 + 6008 + 40000, 1) in rows


def test_periodic_runs(spark):
    texts = [None, "", " \n", "one", "a " * 11, "a " * 12, "x y " * 6 + "x", prose(40) + " " + "p q r s t u v " * 9 + prose(9), prose(1500, 9), "A a " * 6, prose(30), "é ü\x0b" * 7]
    texts += [texts[7]] * 3
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, "b " * 20, 0, 0)], "doc_id long, text string, id int, runs int").repartition(3)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df, collapse=True).collect()}
    for k, text in [*enumerate(texts), (None, "b " * 20)]:
        w = [x for x in re.split(GAP, text or "") if x]
        runs = [(s, e - s, q) for s, e, q in plain_runs(w, 12)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[k]
        assert [tuple(x) for x in r.runs] == runs and (r.n_words, r.collapsed) == (len(w), kept)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """(root, siblings of each leaf, joined level by level)."""
    paths, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k] += "".join(x for j, x in enumerate(nodes[i // 3 * 3:i // 3 * 3 + 3], i // 3 * 3) if j != i)
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest(spark, depth):
    rows = [(k, "hot", f"t{k}", 1) for k in range(100)] + [(3, None, "n", 1), (5, "é", None, 1), (1, "ab", "x", 1), (2, "ab", "", 1), (None, "a", "lost", 1)]
    rows += [(200 + k, f"g{k}", "alone", 1) for k in range(11)] + [(7, "twin", "same", 1)] * 4 + [(8, "twin", "b", 1), (8, "twin", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, key int").withColumn("place", F.lit(9)).withColumn("part", F.lit("x"))
    leaves = df.withColumn("leaf", merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "text")]))
    leaves = leaves.withColumn("shown", F.when(F.col("doc_id") == 4, F.lit("0")).otherwise(F.col("leaf"))).repartition(4)
    tree = merkle.manifest(leaves, "source", ["doc_id"], depth=depth)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, s, t, _ in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, sha(field(d) + field(s) + field(t)), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    want = sorted((str(s), str(x[3]), x[2], trees[s][0], p + upper[k]) for k, s in enumerate(names)
                  for x, p in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]))
    seen = merkle.verified(tree.leaves, tree.root, "shown").withColumn("proof", merkle.proof(F.col("path"))).collect()
    assert sorted((str(r.source), str(r.doc_id), r.leaf, r.subroot, r.proof) for r in seen) == want
    assert {r.root for r in seen} == {root} and all(r.verified == (r.doc_id != 4) for r in seen)
    assert all(r.key == 1 and r.place == 9 and r.part == "x" for r in seen)
    assert {r.source: r.subroot for r in tree.groups.collect()} == {s: t[0] for s, t in trees.items()}


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "s", "ff" * 32)], "doc_id long, source string, leaf string")
    tree = merkle.manifest(one, "source", ["doc_id"])
    row = merkle.verified(tree.leaves, tree.root, "leaf").first()
    assert row.root == row.subroot == row.leaf == row.folded_root and row.path == [] and row.verified
    none = merkle.manifest(one.limit(0), "source", ["doc_id"])
    assert merkle.verified(none.leaves, none.root, "leaf").count() == none.groups.count() == none.root.count() == 0


@pytest.mark.parametrize("length", [16, 32])
def test_cover_reaches_every_word_near_a_home(length):
    words = np.random.default_rng(length).integers(0, 1 << length, 60, dtype=np.uint64)
    row, anchor, home = simhash.cover(words, length)
    near = np.bitwise_count(words[row] ^ anchor)
    assert near.max() <= 2 and near[home].max() <= 1 and home.sum() == len(words)
    for bit in range(length):
        there = set(zip(*(x.tolist() for x in simhash.cover(words ^ (np.uint64(1) << np.uint64(bit)), length)[:2])))
        assert set(zip(row[home].tolist(), anchor[home].tolist())) <= there


def plain_components(values, ids, bits=3):
    label = list(ids)
    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(zip(ids, label))


@pytest.mark.parametrize("busy", [simhash.BUSY, 6])
def test_links_of_crowded_fingerprints(spark, busy):
    rng = random.Random(busy)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = {rng.getrandbits(64) for _ in range(60)} | set(centres)
    for c in centres:  # crowds that share a half, a quarter or nearly all bits
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(60)}
        values |= {c ^ rng.getrandbits(32) << 32 for _ in range(60)}
        values |= {c ^ sum(1 << b for b in rng.sample(range(16, 64), 2)) for _ in range(40)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash._links(spark.createDataFrame([(v,) for v in signed], "bits long"), 3, busy).collect()
    label = dict(zip(signed, range(len(signed))))
    for r in got:
        low, high = sorted((label[r.x], label[r.y]))
        label = {k: low if v == high else v for k, v in label.items()}
    want = plain_components(values, list(range(len(values))))
    assert [label[s] for s in signed] == [want[k] for k in range(len(values))]


def test_simhash(spark):
    base = prose(400)
    texts = [None, "", "\t", "one", "ONE", "two words", base, base.upper(), base + " more", base.replace("w1 ", "w2 ", 1), prose(3000), "ab" * 40000, "é é é é", prose(20)]
    texts += [base + f" tail{k}" for k in range(20)]
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(texts)] + [(None, "one", "x", 3)], "doc_id long, text string, bits string, id int").repartition(4)
    prints = {}
    for k, t in enumerate(texts):
        w = [x for x in re.split(GAP, re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = plain_components(list(prints.values()), list(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in simhash.near_duplicates(df, width=3).collect()}
    assert got == {k: (format(prints[k], "016x"), want[k], want[k] == k) for k in prints}
    assert sum(v != k for k, v in want.items()) > 5 and simhash.near_duplicates(df.limit(0)).count() == 0
