"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_runs, chunk_dedup, decontaminate, language, merkle, near_dedup, nearest, packing, periodic, secret_scan
from . import suffix_dedup, token_codes, token_counts, toxicity
from .common import PLAIN_WORD, SPACED_WORD, id_crc, read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf, "documents"), keep=["doc_id"]))


@query
def op2_token_codes(spark: SparkSession, sf: str) -> DataFrame:
    return token_codes.round_trip(read(spark, sf, "documents"), VOCABULARY)


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), VOCABULARY)


@query
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(read(spark, sf, "documents"), read(spark, sf, "benchmark")))


def _words_sql(text: str, form: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"regexp_extract_all({lower}, '{form}')"


ORACLES["op6_decontamination"] = f"""with d as (
  select row_number() over () as rid, doc_id, {_words_sql('text', PLAIN_WORD.pattern)} as w from documents),
b as (select item_id::varchar as item, {_words_sql('text', PLAIN_WORD.pattern)} as w from benchmark),
item_windows as (
  select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as words
  from (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from (select *, least(len(w), 10) as k from b where len(w) > 0))),
doc_windows as (
  select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as words
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from item_windows) where len(w) >= k)),
hits as (select rid, k, i, item from doc_windows join item_windows using (k, words)),
places as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + k)) as place from hits) group by rid),
items as (
  select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct rid, item from hits) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (rid) left join items using (rid)"""


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held_out = id_crc("doc_id") % 5 == 0
    model = toxicity.fit(docs.where(~held_out), read(spark, sf, "labels").where(~held_out))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dedup.near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op4_near_dedup"] = f"""with recursive d as (
  select doc_id, {_words_sql('text', SPACED_WORD.pattern)} as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') as shingle, k
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from (select *, least(len(w), 4) as k from d where len(w) > 0))),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y using (shingle, k) where x.doc_id <> y.doc_id group by 1, 2)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
reached as (
  select doc_id as a, doc_id as b from d
  union
  select r.a, l.b from reached r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reached group by 1) m using (doc_id)"""


@query
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model, keep=["doc_id"], spans=False).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query
def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.search(read(spark, sf, "embeddings"))


@query
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return byte_runs.digest(suffix_dedup.remove_repeats(read(spark, sf, "documents")))


@query
def op7_chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return byte_runs.digest(chunk_dedup.remove_repeats(read(spark, sf, "documents")))


#: Tokens beyond which ``op11_token_counts`` marks a document.
LIMIT = 512


@query
def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return token_counts.count_tokens(docs, VOCABULARY, keep=["doc_id"], limit=LIMIT)


@query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all documents; those whose id's CRC-32 is divisible by 5 are tampered with before they are checked."""
    docs = read(spark, sf, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(chosen, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    leaf = merkle.leaf_digest([claimed if c == "text" else F.col(c) for c in merkle.FIELDS])
    manifest = merkle.build(docs, carry={"claimed": leaf})
    return merkle.verify(manifest, "claimed").withColumnRenamed("id", "doc_id")


def looped(id: Column, text: Column) -> Column:
    """The tampered texts of ``op13_periodic_runs``: in one of ten, a tail of the words repeats its first ones."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    # first words and repeated stretch as slices: a lambda would work the words out again for every word
    first, stretch = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(stretch, times)), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(first, tail), " ")).otherwise(text)


def _field_sql(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar)::varchar || ':' || {value}::varchar end"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in merkle.FIELDS) + ")"


#: The CRC-32 of an id as text, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, strlen(doc_id::varchar) + 1),
  lambda i: ascii(substr(doc_id::varchar, i::bigint, 1))::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]),
  lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""


def _steps_sql(tree: int, nodes: str, position: str, also: str) -> str:
    """The siblings left and right of each leaf's ancestors, level by level."""
    own = f"l.{position} // (16 ** x.lvl)::bigint"
    sides = ", ".join(
        f"coalesce(string_agg(x.digest, '' order by x.pos) filter (x.pos {sign} {own}), '') as {side}"
        for side, sign in (("lft", "<"), ("rgt", ">"))
    )
    return (
        f"select l.rid, {tree} as tree, x.lvl, {sides} from leaves l join {nodes} x"
        f" on {also} x.n > 1 and x.pos // 16 = l.{position} // (16 ** (x.lvl + 1))::bigint group by l.rid, x.lvl, l.{position}"
    )


ORACLES["op12_merkle"] = f"""with recursive leaves as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n
  from (select row_number() over () as rid, doc_id, dense_rank() over (order by source nulls first) - 1 as g, {_leaf_sql('text')} as leaf,
    case when {_CRC_SQL} % 5 = 0 then {_leaf_sql(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")}
      else {_leaf_sql('text')} end as claimed from documents)),
nodes as (
  select g, 0 as lvl, pos, n, leaf as digest from leaves
  union all
  select g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1
  group by g, lvl, pos // 16, n),
subroots as (select g, digest from nodes where n = 1),
tops as (
  select 0 as lvl, g as pos, count(*) over () as n, digest from subroots
  union all
  select lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from tops where n > 1
  group by lvl, pos // 16, n),
steps as (
  select *, row_number() over (partition by rid order by tree, lvl) as k from (
  {_steps_sql(0, 'nodes', 'pos', 'x.g = l.g and')} union all {_steps_sql(1, 'tops', 'g', '')})),
fold as (
  select rid, 0::bigint as k, claimed as node from leaves
  union all
  select f.rid, s.k, sha256(s.lft || f.node || s.rgt) from fold f join steps s on s.rid = f.rid and s.k = f.k + 1),
proofs as (select rid, sha256(string_agg(lft || rgt, '' order by k)) as proof from steps group by rid),
folded as (select rid, arg_max(node, k) as folded_root from fold group by rid)
select doc_id, leaf, r.digest as subroot, t.digest as root, coalesce(proof, sha256('')) as proof_sha256, folded_root,
  folded_root = t.digest as verified
from leaves l join subroots r on r.g = l.g join folded on folded.rid = l.rid left join proofs on proofs.rid = l.rid,
  (select digest from tops where n = 1) t"""


@query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs, keep=["doc_id"])
    longest = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"]))
        .when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(longest, F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
