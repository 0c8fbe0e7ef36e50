"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.llm import (
    chat, decontamination, merkle, near_dedup, neighbours, packing, periodic_runs, simhash, suffix_dedup, token_files, toxicity, url_filter, warc,
)
from nightsieve.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, files)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_ids(folder, manifest)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_texts(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = """
with words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), items as (
  select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark
  where item_id is not null
), item_shingles as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from items where len(w) > 0
), doc_shingles as (
  select doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from words where len(w) > 0
), sizes as (select item_id, count(*) as n from item_shingles group by item_id),
shared as (
  select d.doc_id, i.item_id, count(distinct d.s) as c from doc_shingles d join item_shingles i on d.s = i.s group by d.doc_id, i.item_id
)
select doc_id, shared.item_id, cast(n as integer) as n_item, cast(c as integer) as n_shared
from shared join sizes on shared.item_id = sizes.item_id where c * 100 >= n * 80
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_conversations(chat.written(chat.format_conversations(turns.unionByName(extra))))


#: Host, start of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of document n stand for page n: a page is bad if its document is toxic or of quality 0."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where ten divides the crc32 of the id, the words from some place on repeat those there with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    gap = "[\\x20\\x09-\\x0D]+"
    words = F.filter(F.split("text", gap), lambda w: w != "")
    n = F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    moved = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return rows.select("doc_id", F.when(F.coalesce(n, F.lit(0)) > 0, moved).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_planted(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.leaf_digest([F.col(n) for n in names])
    changed = merkle.leaf_digest([*(F.col(n) for n in names[:-1]), F.replace("text", F.lit("\n"), F.lit(""))])
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), changed)
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), tampered.alias("changed"))
    leaves = leaves.select("doc_id", "source", "leaf", F.coalesce("changed", "leaf").alias("shown"))
    tree = merkle.manifest(leaves, "source", ["doc_id"])
    rows = merkle.verified(tree.leaves, tree.root, "shown")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = """
with recursive docs as (
  select doc_id, source, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head, text,
    list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)) as crc
  from documents
), leaves as (
  select *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || case when xor(crc, 4294967295) % 2 = 0 then coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')
      else coalesce(octet_length(encode(text)) || ':' || text, '-') end) as shown,
    row_number() over (partition by source order by doc_id nulls first) - 1 as pos
  from docs
), low as (
  select source, 0 as lev, pos, leaf as node, count(*) over (partition by source) as n from leaves
  union all
  select source, lev + 1, pos // 3, sha256(string_agg(node, '' order by pos)), (max(n) + 2) // 3 from low where n > 1 group by source, lev, pos // 3
), subroots as (
  select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos from low where n = 1
), high as (
  select 0 as lev, pos, subroot as node, (select count(*) from subroots) as n from subroots
  union all
  select lev + 1, pos // 3, sha256(string_agg(node, '' order by pos)), (max(n) + 2) // 3 from high where n > 1 group by lev, pos // 3
), low_flanks as (
  select a.source, a.lev, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
    coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from low a join low b on a.source is not distinct from b.source and a.lev = b.lev and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.source, a.lev, a.pos
), high_flanks as (
  select a.lev, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
    coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from high a join high b on a.lev = b.lev and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.lev, a.pos
), steps as (
  select e.doc_id, e.pos as place, e.source, f.lev, f.l, f.r from leaves e join low_flanks f
    on e.source is not distinct from f.source and f.pos = e.pos // (3 ** f.lev)::bigint
  union all
  select e.doc_id, e.pos, e.source, 1000 + f.lev, f.l, f.r from leaves e join subroots s on e.source is not distinct from s.source
    join high_flanks f on f.pos = s.pos // (3 ** f.lev)::bigint
), paths as (
  select place, source, array_agg(list_value(l, r) order by lev) as path from steps group by place, source
)
select e.doc_id, e.leaf, s.subroot, t.root, sha256(coalesce(array_to_string(flatten(p.path), ''), '')) as proof_sha256,
  list_reduce(list_prepend(['', e.shown, ''], coalesce(p.path, [])), lambda x, y: ['', sha256(y[1] || x[2] || y[2]), ''])[2] as folded_root,
  folded_root = t.root as verified
from leaves e join subroots s on e.source is not distinct from s.source
cross join (select node as root from high where n = 1) t
left join paths p on p.place = e.pos and p.source is not distinct from e.source
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_warc, op2_token_files, op3_toxicity, op4_packing, op5_neighbours, op6_decontamination, op7_suffix_dedup, op8_chat,
    op9_url_filter, op10_near_dedup, op11_periodic_runs, op12_merkle, op13_simhash,
)}
CHECKS: dict[str, str] = {"op6_decontamination": OP6_SQL, "op12_merkle": OP12_SQL}
