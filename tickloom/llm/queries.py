"""Registered queries of the corpus operators, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, merkle, mixing, quality_model, quality_rules, secrets, sharding, simhash, substring_dedup, suffix_dedup, token_files, toxicity, whitening
from tickloom.llm.text import held_out
from tickloom.session import cut_lineage, shared_folder

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tickloom-{what}-{uuid.uuid4().hex}"


@query("op1_slot_sharding")
def op1(spark, d):
    # taken from the text before it is placed, so that no text is shuffled
    docs = table(spark, d, "documents").select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    s = sharding.shard(docs, new_folder(spark, "slots"), shards=40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query(
    "op2_source_mix",
    r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
        ('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as u from documents),
s as (select source, cast(sum(size) as bigint) as ss from d group by source),
w as (select source, ss, (row_number() over (order by source nulls last) - 1) % 3 + 1 as wt from s),
o as (select source, ss, wt, row_number() over (order by ss / wt, source) as k from w),
c as (select source, ss, wt, k, (sum(ss) over ()) - 3 * coalesce(sum(ss) over (order by k rows between unbounded preceding and 1 preceding), 0) as l,
        (sum(wt) over ()) - coalesce(sum(wt) over (order by k rows between unbounded preceding and 1 preceding), 0) as op from o),
f as (select min(k) as k from c where 3 * ss * op >= wt * l),
t as (select c.source, c.ss, case when c.ss = 0 then 0.0::double when c.k < f.k then (3 * c.ss)::double
        else (c.wt * (select l from c as x where x.k = f.k))::double / (select op from c as x where x.k = f.k)::double end as target from c, f),
p as (select source, ss, target, case when ss > 0 then floor(target / ss)::bigint else 0 end as whole from t),
r as (select d.*, p.ss, p.target, p.whole, p.target - (p.whole * p.ss)::double as rest,
        sum(size) over (partition by d.source order by u, size rows between unbounded preceding and current row) as run from d join p on d.source is not distinct from p.source),
b as (select source, max(u) as bu, arg_max(size, (u, size)) as bs from r where rest > 0 and (2 * run - size)::double <= 2 * rest group by source)
select r.doc_id, r.size::bigint as size, r.ss::bigint as source_size, r.target,
    ((r.whole + case when b.bu is not null and (r.u < b.bu or (r.u = b.bu and r.size <= b.bs)) then 1 else 0 end) * r.size)::bigint as taken
from r left join b on r.source is not distinct from b.source
""",
)
def op2(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", "taken")


@query("op3_simhash")
def op3(spark, d):
    g = simhash.simhash_groups(table(spark, d, "documents"))
    return g.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query(
    "op6_benchmark_containment",
    r"""
with it as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '') as w from benchmark),
ig as (select distinct item_id, least(len(w), 5) as width, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) as gram from it where len(w) > 0),
n as (select item_id, count(*) as n from ig group by item_id),
dt as (select distinct doc_id, text from documents),
dw as (select doc_id, row_number() over () as k, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '') as w from dt),
wd as (select distinct width from ig),
dg as (select distinct doc_id, k, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as gram from dw, wd where len(w) >= width)
select dg.doc_id, ig.item_id, count(*) as n_found, max(n.n) as n_item, count(*) / max(n.n) as containment
from dg join ig using (gram, width) join n on n.item_id is not distinct from ig.item_id
group by dg.doc_id, dg.k, ig.item_id having count(*) / max(n.n) >= 0.8
""",
)
def op6(spark, d):
    return decontaminate.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("tk")


def learnable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where(~held_out(F.col("doc_id")))


@query("op7_toxicity")
def op7(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.learn(docs, learnable(spark, d))
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_suffix_dedup")
def op9(spark, d):
    s = suffix_dedup.strip_repeats(table(spark, d, "documents"))
    return s.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup")
def op10(spark, d):
    s = substring_dedup.strip_passages(table(spark, d, "documents"))
    return s.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_quality_cascade")
def op4(spark, d):
    return quality_rules.apply_rules(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_quality_model")
def op5(spark, d):
    docs = table(spark, d, "documents")
    model = quality_model.learn(docs, learnable(spark, d))
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_model.score(F.col("text"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def labelled_secrets(found: DataFrame) -> DataFrame:
    """Findings that their format or context settles; the others have a null label.

    True: issued keys, hex tokens and passwords in either case, what follows a name or stands in a URL's login and is
    more than letters. False: numbers, phones, cards and whole mail addresses. Letters or an ``@`` alone settle nothing.
    """
    true = r"^(A[KS]IA[A-Z0-9]{16}|[0-9a-f]{40}|[0-9a-f]{18}|[0-9A-F]{40}|[0-9A-F]{18}|gh[a-z]_[A-Za-z0-9]{20,}|(sk|pk|rk)[-_][A-Za-z0-9_\-]{16,})$"
    number = r"^[0-9.\-:+/]+$"
    mail = r"^[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"
    v, context = F.col("value"), F.greatest(*[F.col("features")[secrets.FEATURES.index(x)] for x in ("named", "credential")]) > 0
    sample = F.col("features")[secrets.FEATURES.index("sample_word")] > 0
    told = context & ~sample & v.rlike(r"[^A-Za-z]") & (F.length(v) >= 6)
    return found.withColumn("label", F.when(v.rlike(number) & ~context, False).when(v.rlike(true) | told, True).when(v.rlike(mail) & ~context, False))


@query(
    "op11_merkle_manifest",
    r"""
with recursive f as (select doc_id, source, lang, n_chars, text, case when text is null then null when tamper then replace(text, chr(10), '') else text end as other from (
    select *, doc_id is not null and list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2)))) % 2 = 1 as tamper from documents)),
h as (select doc_id, source,
        concat(coalesce(concat(strlen(cast(doc_id as varchar)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(cast(n_chars as varchar)), ':', n_chars), '-')) as head, text, other from f),
l as (select doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) as leaf, sha256(concat(head, coalesce(concat(strlen(other), ':', other), '-'))) as claim from h),
leaves as (select *, row_number() over (order by doc_id nulls first, leaf) as k, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) as tree from l),
up as (select tree, 0 as level, pos, n, leaf as digest from leaves
    union all select tree, level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' order by pos)) from up where n > 1 group by tree, level, pos // 3),
tops as (select tree, digest as subroot from up where n = 1),
over as (select 0 as level, tree - 1 as pos, (select count(*) from tops) as n, subroot as digest from tops
    union all select level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' order by pos)) from over where n > 1 group by level, pos // 3),
nodes as (select tree, level, pos, n, digest from up where n > 1 union all select 0, level, pos, n, digest from over where n > 1),
linked as (select a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as before, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as after,
        case when a.tree > 0 and a.n <= 3 then 0 else a.tree end as p_tree, case when a.tree > 0 and a.n <= 3 then 0 else a.level + 1 end as p_level, case when a.tree > 0 and a.n <= 3 then a.tree - 1 else a.pos // 3 end as p_pos
    from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.pos // 3 = b.pos // 3 group by a.tree, a.level, a.pos, a.n),
climb as (select k, case when n > 1 then tree else 0 end as tree, 0 as level, case when n > 1 then pos else tree - 1 end as pos, claim as digest, '' as proof from leaves
    union all select c.k, p_tree, p_level, p_pos, sha256(concat(before, digest, after)), concat(proof, before, after) from climb c join linked x on c.tree = x.tree and c.level = x.level and c.pos = x.pos),
ended as (select k, digest as folded_root, sha256(proof) as proof_sha256 from climb c where not exists (select 1 from linked x where c.tree = x.tree and c.level = x.level and c.pos = x.pos))
select doc_id, leaf, subroot, (select digest from over where n = 1) as root, proof_sha256, folded_root, folded_root = (select digest from over where n = 1) as verified
from leaves join ended using (k) join tops using (tree)
""",
)
def op11(spark, d):
    docs = table(spark, d, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    m = merkle.manifest(docs, new_folder(spark, "merkle"), found={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    c = merkle.check(m)
    return c.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


@query("op12_simple8b_tokens")
def op12(spark, d):
    import public_tokenizers

    r = token_files.token_files(table(spark, d, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return r.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op13_polarised_whitening")
def op13(spark, d):
    w = whitening.whitened(table(spark, d, "embeddings"), most=8)
    return w.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


@query("op8_secret_forest")
def op8(spark, d):
    found = cut_lineage(secrets.findings(table(spark, d, "documents")))
    forest = secrets.learn(labelled_secrets(found).where(~held_out(F.col("id"))), F.concat_ws(":", "id", "start"))
    s = secrets.judge(found, forest)
    return s.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))
