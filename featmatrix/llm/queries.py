"""The registered query of each operator: production parameters over whole tables, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmatrix.llm.common import read_table
from featmatrix.llm.line_dedup import ORACLE as LINE_ORACLE


def op1_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.quality import line_first_quality

    return line_first_quality(read_table(spark, sf_dir, "documents")).drop("cleaned")


def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.langid import fit, held_out, predict

    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_front_coded_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.packing import pack_examples

    return pack_examples(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.bpe import round_trip_digest

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digest(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.line_dedup import line_report

    return line_report(read_table(spark, sf_dir, "documents"))


def op9_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.common import crc_mod
    from featmatrix.llm.maxent import fit, score

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return score(docs, fit(docs.where(~held_out))).withColumn("held_out", held_out)


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.pii import find, fit

    docs = read_table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.common import crc_mod
    from featmatrix.llm.merkle import manifest

    return manifest(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0).proofs()


def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.compression import fit, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from featmatrix.llm.lexical import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sorted_projections": op1_sorted_projections,
    "op2_quality_lines": op2_quality_lines,
    "op3_language_centroids": op3_language_centroids,
    "op4_front_coded_suffixes": op4_front_coded_suffixes,
    "op5_odd_sketches": op5_odd_sketches,
    "op6_vector_packing": op6_vector_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_runs": op8_line_runs,
    "op9_hashed_maxent": op9_hashed_maxent,
    "op10_skip_chain_pii": op10_skip_chain_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_compression_quality": op12_compression_quality,
    "op13_bag_search": op13_bag_search,
}

VECTORS_SQL = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) as (
  select vec_id, vec_id from good union select r.vec_id, l.b from reach r join links l on r.other = l.a),
smallest as (select vec_id, min(other) as component_id from reach group by 1),
degree as (select a as vec_id, count(*) as n_links from links group by 1)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id,
  coalesce(e.vec_id = coalesce(component_id, e.vec_id), true) as kept
from embeddings e left join smallest using (vec_id) left join degree using (vec_id)
"""

SHINGLES_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
sized as (select doc_id, len(s)::bigint as n, s from sets),
each as (select doc_id, n, unnest(s) as x from sized),
links as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from sized union select r.doc_id, l.b from reach r join links l on r.other = l.a),
smallest as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sized join smallest using (doc_id)
"""

def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}, '-')"


def _crc_sql(column: str) -> str:
    """crc32 of the text of a column, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split({column}::varchar, ''), lambda d: ascii(d)::bigint),
    lambda c, b: {step}))"""


def _sides_sql(part: str) -> str:
    """The digests before and after a node in its run."""
    window = f"string_agg(digest, '') over (partition by {part} order by idx rows between"
    return f"coalesce({window} unbounded preceding and 1 preceding), '') as l, coalesce({window} 1 following and unbounded following), '') as r"


def _levels_sql(n: str) -> str:
    return " + ".join(f"({n} > {16**k})::int" for k in range(10))


MERKLE_SQL = f"""
with recursive heads as (
  select doc_id, source, text, {" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))} as head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from documents),
hashed as (
  select doc_id, source, sha256(head || {_field_sql("text")}) as leaf,
    case when {_crc_sql("doc_id")} % 5 = 0 then sha256(head || {_field_sql("lowered")}) else sha256(head || {_field_sql("text")}) end as shown from heads),
numbered as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
    dense_rank() over (order by source nulls first) - 1 as g, row_number() over () as rid from hashed),
heights as (select g, {_levels_sql("count(*)")} as h from numbered group by g),
up as (
  select g, h, 0 as lvl, idx, leaf as digest from numbered join heights using (g)
  union all select g, h, lvl + 1, idx // 16, sha256(string_agg(digest, '' order by idx)) from up where lvl < h group by g, h, lvl, idx // 16),
subroots as (select g, digest as subroot from up where lvl = h),
top as (
  select {_levels_sql("count(*) over ()")} as h, 0 as lvl, g as idx, subroot as digest from subroots
  union all select h, lvl + 1, idx // 16, sha256(string_agg(digest, '' order by idx)) from top where lvl < h group by h, lvl, idx // 16),
steps as (select g, lvl, idx, {_sides_sql("g, lvl, idx // 16")} from up where lvl < h),
top_steps as (select lvl, idx, {_sides_sql("lvl, idx // 16")} from top where lvl < h),
folds as (
  select rid, g, 0 as lvl, idx, shown as digest, '' as others from numbered
  union all select rid, f.g, f.lvl + 1, f.idx // 16, sha256(l || digest || r), others || l || r
  from folds f join steps s on f.g = s.g and f.lvl = s.lvl and f.idx = s.idx),
top_folds as (
  select rid, 0 as lvl, g as idx, digest, others from folds join heights using (g) where lvl = h
  union all select rid, f.lvl + 1, f.idx // 16, sha256(l || digest || r), others || l || r
  from top_folds f join top_steps s on f.lvl = s.lvl and f.idx = s.idx),
tip as (select digest as root, h from top where lvl = h)
select doc_id, leaf, subroot, root, sha256(others) as proof_sha256, digest as folded_root, digest = root as verified
from numbered join subroots using (g) join top_folds f using (rid) join tip on f.lvl = tip.h
"""

SEARCH_SQL = r"""
with doc_terms as (
  select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
lengths as (select d, count(*) as n from doc_terms group by d),
totals as (select count(*)::bigint as docs, sum(n)::bigint as len from lengths),
tfs as (select d, doc_id, term, count(*) as tf from doc_terms group by all),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from tfs group by term), totals),
ms as (select d, 50 + (50 * n * docs) // len as m from lengths, totals),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null),
scored as (
  select item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from item_terms join tfs using (term) join weights using (term) join ms using (d) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_sorted_projections": VECTORS_SQL,
    "op5_odd_sketches": SHINGLES_SQL,
    "op8_line_runs": LINE_ORACLE,
    "op11_merkle_manifest": MERKLE_SQL,
    "op13_bag_search": SEARCH_SQL,
}
