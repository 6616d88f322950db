"""Source divergence audit: how far the words of a language's sources lie apart, in exact whole numbers.

A term is a run of letters and of anything beyond ASCII, only A-Z lower-cased; a language keeps the terms of at least
`min_documents` of its documents. Each group (language, source), and each language as a whole, gives every kept term the
smoothed share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N its count of kept terms, V their number. Part `pair` sums
|p - q| over all kept terms for each two sources of a language, part `term` lists the terms that a source has more of than
its language, `top` at most.

Terms are counted by group in each task before they are shuffled. The summed counts are sorted by language and term, as
UTF-8 is ordered; kept terms in turn are a dictionary, cut into chunks, and a term's number in its chunk is its place in a
sorted array. So each source is a vector of a chunk (numbers by searchsorted, counts by bincount), and smaller numbers are
earlier terms where values tie. A task holds a chunk's vectors of two blocks of sources, however many terms, documents and
sources there are; chunks add up.

Null texts, languages and sources are ''. Empty texts have no terms but their group occurs; without kept terms a pair's
value is 0 and no term is listed. Very long texts are counted whole, piece by piece. Repeated rows are documents of their
own. An empty table gives no rows; further columns are ignored, whatever they are called. Counts are exact up to 9 * 10^15
kept terms of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import few, long_texts, materialise
from .workers import tidy

ONE = 1_000_000_000
#: By byte: what a term holds, A-Z in lower case, and a space for all else.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms and counts of a chunk, sources of a block, distinct terms that a counting task holds, bytes of a text taken at once.
CHUNK, ENTRIES, BLOCK, HELD, PIECE = 1 << 14, 1 << 20, 128, 400_000, 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of long ones in turn."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@tidy()
def _counted(batches):
    """(lang, source, term, n, documents): counts of a task's rows; the term '' stands for the group itself."""
    total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        for (lang, source), (counts, documents) in total.items():
            terms = [b"", *counts]
            n = [0, *counts.values()]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array(n[at : at + 50_000], pa.int64()), pa.array([documents[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "documents"],
                )
        total.clear()

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1)]
        texts = batch.column(2).cast(pa.binary())
        for row, (lang, source) in enumerate(zip(*columns)):
            counts, documents = total.setdefault((lang, source), (Counter(), Counter()))
            held -= len(counts)
            own: set[bytes] = set()
            for terms in _pieces(texts[row].as_py()):
                counts.update(terms)
                own.update(terms)
            documents.update(own)
            held += len(counts)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


_ENCODED = "lang string, chunk long, source string, terms array<string>, ids array<int>, counts array<long>"


@tidy()
def _encoded(batches, least: int):
    """Rows sorted by language, term and source: each chunk's dictionary and whole counts, a row without source, then its sources' counts.

    A language's last chunk of a task may be short. Chunk numbers ascend with terms within a language.
    """
    serial = TaskContext.get().partitionId() << 32
    lang: str | None = None
    term: bytes | None = None
    own: list[tuple[str, int, int]] = []  # the term at hand: source, count, documents
    terms: list[bytes] = []
    rows: list[tuple[str, bytes, int]] = []  # the chunk at hand: source, kept term, count

    def chunk():
        nonlocal serial
        if terms:
            kept = np.array(terms, object)  # in order, as they came
            ids = np.searchsorted(kept, np.array([r[1] for r in rows], object))
            counts = np.array([r[2] for r in rows], np.int64)
            whole = np.bincount(ids, counts, len(kept)).astype(np.int64)
            found = [(None, [t.decode() for t in terms], np.arange(len(kept)), whole)]
            names, source = np.unique(np.array([r[0] for r in rows], object), return_inverse=True)
            order = np.argsort(source, kind="stable")
            edges = np.searchsorted(source[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                part = order[edges[k] : edges[k + 1]]
                found.append((name, None, ids[part], counts[part]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([serial] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())),
                 pa.array([f[2] for f in found], pa.list_(pa.int32())), pa.array([f[3] for f in found], pa.list_(pa.int64()))],
                ["lang", "chunk", "source", "terms", "ids", "counts"],
            )
            serial += 1
            terms.clear()
            rows.clear()

    def close():
        if own and sum(d for _, _, d in own) >= least:
            terms.append(term)
            rows.extend((s, term, n) for s, n, _ in own)
        own.clear()

    for batch in batches:
        for now, source, word, n, documents in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["term"].cast(pa.binary()).to_pylist(), batch["n"].to_pylist(), batch["documents"].to_pylist()):
            if word != term or now != lang:
                close()
                if now != lang or len(terms) >= CHUNK or len(rows) >= ENTRIES:
                    yield from chunk()
                lang, term = now, word
            own.append((source, n, documents))
    close()
    yield from chunk()


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), by long division in steps of 1,000, so that nothing exceeds 64 bits."""
    whole = n + 5 * v
    out, rest = np.divmod(counts + 5, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _compared(table: pa.Table, top: int) -> pa.Table:
    """A chunk's share of the values of one block of sources, or of two: sums for pairs, the best terms for sources of a block with itself."""
    rows = table.to_pylist()
    whole = next((r for r in rows if r["source"] is None), None)
    rows = sorted((r for r in rows if r["source"] is not None), key=lambda r: (r["block"], r["source"]))
    out: list[tuple[str, str, str, int]] = []
    if rows:
        width, v = rows[0]["width"], rows[0]["kept"]
        vectors = np.zeros((len(rows), width), np.int64)
        counts = []
        for k, r in enumerate(rows):
            # bincount sums in doubles, in which counts up to the stated bound are exact
            counts.append(np.bincount(np.array(r["ids"] or [], np.int64), r["counts"] or [], width).astype(np.int64))
            vectors[k] = shares(counts[k], r["n"], v)
        blocks = [r["block"] for r in rows]
        two = blocks[0] != blocks[-1]
        for k, r in enumerate(rows):
            sums = np.abs(vectors - vectors[k]).sum(axis=1)
            out += [("pair", r["source"], x["source"], int(s)) for x, s in zip(rows, sums) if x is not r and (not two or x["block"] != r["block"])]
        if whole is not None:
            terms, q = whole["terms"], shares(np.array(whole["counts"], np.int64), whole["n"], v)
            for k, r in enumerate(rows):
                more = vectors[k] - q
                found = np.flatnonzero((counts[k] > 0) & (more > 0))
                best = found[np.lexsort((found, -more[found]))[:top]]
                out += [("term", r["source"], terms[i], int(more[i])) for i in best]
    lang = table["lang"][0].as_py()
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{c: pa.array(x, t) for c, x, t in zip(("part", "source", "item", "value"), columns, (pa.string(), pa.string(), pa.string(), pa.int64()))}})


def encoded(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = 30) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source) that occur, and the chunks (lang, chunk, source, terms, ids, counts) of the kept terms.

    The chunk's row without source has its dictionary in `terms` and the language's counts, the others a source's counts.
    """
    long_texts(documents.sparkSession)
    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    counted = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "term-counts")
    groups = counted.where("term = ''").select("lang", "source")
    in_order = counted.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return groups, materialise(in_order.mapInArrow(lambda b: _encoded(b, min_documents), _ENCODED), "term-chunks")


def divergence(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): ranks from 1 in each group and part, larger values first, then the item."""
    groups, chunks = encoded(documents, text_col=text_col, lang_col=lang_col, source_col=source_col, min_documents=min_documents)
    whole = chunks.where("source is null")
    # 'kept' is the language's number of kept terms, n a group's or language's count of them
    langs = whole.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"), F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n"))
    own = chunks.where("source is not null").groupBy("lang", "source").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n"))
    block = ((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / BLOCK).cast("int")
    sources = groups.join(own, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left")
    sources = sources.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"), block.alias("block"))
    sources = materialise(sources, "sources")
    last = sources.groupBy("lang").agg(F.max("block").alias("last"))
    # every chunk has a vector of every source of its language, also of those that hold none of its terms
    width = whole.select("lang", "chunk", F.size("terms").alias("width"))
    members = width.join(few(sources), "lang").join(chunks.select("lang", "chunk", "source", "ids", "counts").where("source is not null"), ["lang", "chunk", "source"], "left")
    members = members.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    none = lambda kind: F.lit(None).cast(kind)
    vectors = members.select("lang", "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", none("array<string>").alias("terms"), "ids", "counts", "n", "kept", "width", "block")
    totals = whole.join(langs, "lang").join(last, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    totals = totals.select("lang", "chunk", F.col("block").alias("i"), F.col("block").alias("j"), none("string").alias("source"), "terms", none("array<int>").alias("ids"), "counts", "n", "kept", F.size("terms").alias("width"), "block")
    found = vectors.unionByName(totals).groupBy("lang", "chunk", "i", "j").applyInArrow(lambda t: _compared(t, top), "lang string, part string, source string, item string, value long")
    # pairs of languages without kept terms have no chunk
    bare = sources.where("kept = 0")
    pairs = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", F.lit("pair").alias("part"), "source", "item", F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


#: DuckDB: every kept term of every group, in 128-bit whole numbers.
ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
o as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from o group by all having count(distinct r) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
l as (select lang, count(*) as v, sum(total) as n from k group by lang),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as count, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v)::hugeint as p, 1 + (1000000000::hugeint * (k.total + 5)) // (l.n + 5 * l.v)::hugeint as q
  from s join k on k.lang = s.lang join l on l.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(v, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) z on z.lang = x.lang and z.source = x.source and z.item = y.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p where count > 0 and p > q),
both_parts as (select * from pairs union all select * from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from both_parts qualify part = 'pair' or rank <= 50"""
