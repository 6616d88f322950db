"""The registered queries of this subpackage: each a thin layer over its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table


def _fold_of(column: str, parts: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), _fold_of("doc_id", 5) != 0)
    held = F.coalesce(_fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = quality.score(documents, model).select(F.col("id").alias("doc_id"), "score").select("doc_id", held, "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"), _fold_of("doc_id", 4) != 2)
    scored = documents.select("doc_id", F.coalesce(_fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links, set_id, set_size) of every document, by 5-word sets and 0.8 or more."""
    from . import jaccard

    return jaccard.similar(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as s

    # a ledger of this run: what it lacks is scanned, appended and read back
    found = s.scan_versions(table(spark, sf_dir, "documents"), path_col="doc_id", text_col="text", ledger=shared_dir(spark, "secret-ledger"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    digest = F.sha2(s.joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), digest, s.joined(spans).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, best, needed) of every document that overlaps a benchmark item."""
    from . import decontamination

    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_documents(manifest)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    found = warc.read(warc.normalise(warc.write(table(spark, sf_dir, "pages"))))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.similar(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.repeated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("removed")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import source_divergence

    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import best_fit

    return best_fit.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_jaccard, op3_secret_scan, op4_toxicity, op5_decontamination, op6_token_files, op7_warc, op8_embedding_dedup, op9_packing, op10_repeats, op11_source_divergence, op12_filter_audit, op13_best_fit, pipeline)}


#: Links of documents by their whole sets, pair by pair; classes by following links.
JACCARD_SQL = r"""
with recursive d as (select doc_id, row_number() over (order by doc_id nulls last, text) as r, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
g as (select distinct r, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') as gram from (select r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as p from d where len(w) > 0)),
n as (select r, count(*) as n from g group by r),
shared as (select a.r as a, b.r as b, count(*) as nb from g a join g b on a.gram = b.gram and a.r < b.r group by all),
near as (select a, b, nb = x.n and nb = y.n as same from shared join n x on x.r = a join n y on y.r = b where nb >= 0.8 * (x.n + y.n - nb)
  union all select x.r, y.r, true from d x join d y on len(x.w) = 0 and len(y.w) = 0 and x.text = y.text and x.r < y.r),
links as materialized (select a, b, same from near union all select b, a, same from near),
reach as (select a, b from links union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a as r, min(b) as c from reach group by a), counted as (select a as r, count(*) as n_links, count(*) filter (same) as twins, min(b) filter (same) as twin from links group by a)
select d.doc_id, least(d.r, c) as c, coalesce(n_links, 0) as n_links, least(d.r, coalesce(twin, d.r)) as t, 1 + coalesce(twins, 0) as set_size from d left join class using (r) left join counted using (r)"""
JACCARD_SQL = f"""with found as ({JACCARD_SQL}), named as (select doc_id, row_number() over (order by doc_id nulls last, text) as r from documents)
select found.doc_id, x.doc_id as class_id, n_links, y.doc_id as set_id, set_size from found join named x on x.r = c join named y on y.r = t"""

#: Every pair of vectors of a label.
EMBEDDING_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
u as (select * from v where list_bool_or(list_transform(e, lambda x: x <> 0))),
links as materialized (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.93),
reach as (select a, b from links union select reach.a, links.b from reach join links on links.a = reach.b),
c as (select a, min(b) as least from reach group by a), n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id, least(vec_id, coalesce(c.least, vec_id)) = vec_id as kept from embeddings left join c on c.a = vec_id left join n on n.a = vec_id"""

#: Every window of 100 bytes.
REPEATS_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, array_slice(b, p, p + 99) as w from (select doc_id, b, unnest(range(1, n - 98)) as p from d where n >= 100)),
again as (select doc_id, p from w qualify row_number() over (partition by w order by doc_id, p) > 1),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from (select *, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as new from again)),
spans as (select doc_id, min(p) as s, max(p) + 99 as e from runs group by doc_id, run),
left_over as (select doc_id, lag(e, 1, 0) over (partition by doc_id order by s) + 1 as s, s - 1 as e from spans union all select d.doc_id, coalesce(max(e), 0) + 1, max(n) from d left join spans using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(case when s <= e then hex(array_slice(b, s, e)) else '' end, '' order by s) as h from left_over join d using (doc_id) group by doc_id),
total as (select doc_id, sum(e - s + 1) as gone, count(*) as runs from spans group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(runs, 0) as n_spans, sha256(from_hex(h)) as kept_sha256 from d join kept using (doc_id) left join total using (doc_id)"""


def _secrets_sql() -> str:
    """Matches of each kind one after the other, each sought in what the one before left."""
    from . import secret_scan as s

    patterns = {"assign": s.ASSIGN.pattern, "access": s.ACCESS.pattern, "hex": s.HEX.pattern, **{k: p.pattern for k, (_, p) in s.MORE.items()}}
    quoted = ", ".join("('{}', {}, '{}')".format(k, n, p.replace("'", "''")) for n, (k, p) in enumerate(patterns.items()))
    steps = " union all ".join(
        f"select r, '{k}' as kind, {n} as n, substring(rest, strpos(rest, m) + length(m)) as rest, off + strpos(rest, m) - 1 + length(m) as off, off + strpos(rest, m) - 1 as start, off + strpos(rest, m) - 1 + length(m) as stop, "
        + ("length(regexp_extract(m, '{0}', 2)) >= 12".format(p.replace("'", "''")) if k == "assign" else "length(m) >= 18" if k == "access" else "true")
        + " as good from (select *, regexp_extract(rest, '{}', 0) as m from found where kind = '{}') where m <> ''".format(p.replace("'", "''"), k)
        for n, (k, p) in enumerate(patterns.items())
    )
    return f"""
with recursive d as (select doc_id, row_number() over () as r, coalesce(text, '') as text from documents), kinds(kind, n, pattern) as (values {quoted}),
found as (select r, kind, cast(n as integer) as n, text as rest, cast(0 as bigint) as off, cast(null as bigint) as start, cast(null as bigint) as stop, false as good from d cross join kinds union all select * from ({steps})),
spans as (select r, n, kind, start, stop, kind || ':' || start || ':' || stop as s from found where good),
x as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(s, ',' order by start, n, stop) as spans, string_agg(s, ',' order by start, n, stop) filter (n < 3) as base from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join x using (r)"""


def _oracles() -> dict[str, str]:
    from . import decontamination, filter_audit, source_divergence

    op7 = """
        with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
        g as (select h, min(page_id) as f from p where n >= 100 group by h)
        select page_id, n as payload_bytes, sha256(p.h) as payload_digest,
            case when f is null or f = page_id then 'response' else 'revisit' end as record_type, case when f <> page_id then f end as refers_to
        from p left join g on p.h = g.h and n >= 100"""
    return {
        "op2_jaccard": JACCARD_SQL, "op3_secret_scan": _secrets_sql(), "op5_decontamination": decontamination.ORACLE, "op7_warc": op7,
        "op8_embedding_dedup": EMBEDDING_SQL, "op10_repeats": REPEATS_SQL, "op11_source_divergence": source_divergence.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
    }


ORACLE_SQL: dict[str, str] = _oracles()
