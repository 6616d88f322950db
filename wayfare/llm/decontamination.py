"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A token is a run of letters, digits and underscores, in lower case. Each mask selects positions of a run of tokens and
ignores the others; the hashes of the selected tokens of documents and benchmark items are joined. Around a hit the tokens of
both are compared: the pair is reported if some window of `window` tokens that holds the hit has at most `substitutions` that
differ. The three masks together meet every way to substitute three of fifteen tokens, so with these defaults the seeds
lose no such overlap.

Items shorter than the window are one window of their own, of which a fifth may differ (rounded down). Their seeds are not
the masks but runs of tokens that part the item, one more than tokens that may differ, so that some run is whole in every
overlap; items of up to four tokens are one run, found verbatim. Documents get seeds of the run sizes that the benchmark
needs.

Places of one text with equal tokens all around (as far as a window reaches) give equal results, so one of them is compared:
a text that repeats a few words over and over has few hits, however long it is. Tokens are then read from chunks of a
text, so a row holds `CHUNK` tokens and two windows at most, of documents and items alike; seeding holds the tokens of one text.

Null or empty texts match nothing. Rows that share an id, documents or items, give one row for each
(document id, item id); rows without an id are compared too and have null there. Equal texts are compared once. Empty tables
give an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import few, materialise

#: The selected positions of each mask.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 6, 9, 10), (0, 1, 5, 6, 8, 10))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def _hashed(texts: DataFrame, *keys: str) -> DataFrame:
    return texts.select(*keys, F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))


def _seeded(texts: DataFrame, masks: tuple[tuple[int, ...], ...], window: int, *keys: str) -> DataFrame:
    """(keys, at, near, seed): the hash of every mask at every place, null where the mask reaches beyond the last token.

    near is the hash of all tokens that a window holding this place can reach. The token hashes are read in place, row by
    row, so that no array of seeds arises however long a text is.
    """
    seeds = []
    for k, mask in enumerate(masks):
        own = ", ".join(f"get(h, at + {o})" for o in mask)
        seeds.append(f"if(at + {mask[-1]} < size(h), xxhash64({k}, {own}), null)")
    places = _hashed(texts, *keys).select(*keys, "h", F.posexplode("h").alias("at", "_token"))
    return places.select(*keys, "at", F.expr(_near(window)).alias("near"), F.explode(F.expr(f"array({', '.join(seeds)})")).alias("seed"))


def _near(window: int) -> str:
    return f"xxhash64({', '.join(f'coalesce(get(h, at + {o}), 0L)' for o in range(1 - window, window))})"


#: Tokens of a chunk.
CHUNK = 4096


def _chunks(texts: DataFrame, window: int, name: str, *keys: str) -> DataFrame:
    """(keys, {name}_chunk, {name}_from, {name}_h, {name}_n): token hashes of a chunk and a window on each side, from which place on, and the text's tokens."""
    reach = window - 1
    first = f"greatest(0, k * {CHUNK} - {reach})"
    cut = f"transform(sequence(0, (size(h) - 1) div {CHUNK}), k -> named_struct('{name}_chunk', k, '{name}_from', {first}, '{name}_h', slice(h, {first} + 1, {CHUNK + 2 * reach}), '{name}_n', size(h)))"
    return _hashed(texts, *keys).where("size(h) > 0").select(*keys, F.inline(F.expr(cut)))


def _runs(size: int, differ: int) -> list[tuple[int, int]]:
    """(begin, size) of runs that part an item of `size` tokens, of which one is whole whichever `differ` tokens differ."""
    parts = min(size, differ + 1)
    ends = [size * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _run_seeds(items: DataFrame, runs: dict[int, list[tuple[int, int]]], number: dict[int, int], window: int) -> DataFrame:
    """(item_no, at, near, seed) of short items, their seeds as _seeded has them; number: the mask of each run size."""
    seed = lambda at, size: f"named_struct('at', {at}, 'seed', xxhash64({number[size]}, {', '.join(f'get(h, {at + o})' for o in range(size))}))"
    cases = " ".join(f"when {n} then array({', '.join(seed(*r) for r in own)})" for n, own in runs.items())
    return _hashed(items, "item_no").select("item_no", "h", F.inline(F.expr(f"case size(h) {cases} end"))).select("item_no", "at", F.expr(_near(window)).alias("near"), "seed")


def by_text(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 15, substitutions: int = 3, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """(id, text_key, item, best, needed): an overlap of a document's text, told from others of its id by text_key(text)."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    items = materialise(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")
    length = F.size(tokens(F.col("text")))
    short = [r["n"] for r in items.select(length.alias("n")).where(f"n > 0 and n < {window}").distinct().orderBy("n").collect()]
    seeds = _seeded(items.where(length >= window), masks, window, "item_no")
    if short:
        runs = {n: _runs(n, n * substitutions // window) for n in short}
        sizes = sorted({size for own in runs.values() for _, size in own})
        seeds = seeds.union(_run_seeds(items.where(length < window), runs, {size: len(masks) + k for k, size in enumerate(sizes)}, window))
        masks = (*masks, *(tuple(range(size)) for size in sizes))
    # of places alike all around the first stands for all, in items as in documents
    tests = seeds.where("seed is not null").groupBy("seed", "item_no", "near").agg(F.min("at").alias("item_at")).select("seed", "item_no", "item_at")
    tests = materialise(tests, "benchmark-seeds")
    hits = _seeded(docs, masks, window, "text_key").join(few(tests), "seed").groupBy("text_key", "item_no", "item_at", "near").agg(F.min("at").alias("at"))
    hits = materialise(hits.select("text_key", "item_no", "item_at", "at"), "benchmark-hits")
    near = docs.select("text_key", "text").join(few(materialise(hits.select("text_key").distinct(), "benchmark-near"), 100_000), "text_key", "left_semi")
    near = _chunks(near.groupBy("text_key").agg(F.any_value("text").alias("text")), window, "doc", "text_key")
    placed = hits.withColumns({"doc_chunk": F.expr(f"at div {CHUNK}"), "item_chunk": F.expr(f"item_at div {CHUNK}")})
    both = placed.join(near, ["text_key", "doc_chunk"]).join(_chunks(items, window, "item", "item_no"), ["item_no", "item_chunk"])
    equal = f"transform(sequence({1 - window}, {window - 1}), o -> if(get(doc_h, at + o - doc_from) = get(item_h, item_at + o - item_from), 1, 0))"
    # tokens beyond an item's ends equal nothing, so a window that hangs over has no more than one inside
    best = f"array_max(transform(sequence(1, {window}), s -> aggregate(slice(same, s, {window}), 0, (a, x) -> a + x)))"
    needed = f"if(item_n < {window}, item_n - floor(item_n * {substitutions} / {window}), {window - substitutions})"
    found = both.select("text_key", "item_no", F.expr(needed).cast("int").alias("needed"), F.expr(equal).alias("same")).select("text_key", "item_no", "needed", F.expr(best).alias("best"))
    found = found.where("best >= needed").groupBy("text_key", "item_no").agg(F.max("best").alias("best"), F.max("needed").alias("needed"))
    found = found.join(items.select("item_no", "item"), "item_no").groupBy("text_key", "item").agg(F.max("best").alias("best"), F.max("needed").alias("needed"))
    found = few(materialise(found, "benchmark-found"), 100_000)
    return docs.select("id", "text_key").join(found, "text_key").select("id", "text_key", "item", "best", "needed").distinct()


def text_key(text: Column) -> Column:
    """The text's SHA-256, that of the empty text for null."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def overlaps(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(id, item, best, needed): best is the largest number of equal tokens in a window of an overlap."""
    return by_text(documents, benchmark, **options).groupBy("id", "item").agg(F.max("best").alias("best"), F.max("needed").alias("needed"))


#: DuckDB: candidates by a mask that also meets every three substitutions of fifteen, for shorter items by any equal token, then the same comparison.
ORACLE = r"""
with docs as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as t from documents),
items as (select item_id, row_number() over () as q, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as t from benchmark),
dt as (select doc_id, r, p, t[p] as a, t[p + 1] as b, t[p + 2] as c, t[p + 4] as e from (select doc_id, r, t, unnest(range(1, len(t) + 1)) as p from docs)),
it as (select item_id, q, p, n, t[p] as a, t[p + 1] as b, t[p + 2] as c, t[p + 4] as e from (select item_id, q, t, len(t) as n, unnest(range(1, len(t) + 1)) as p from items)),
cand as (select r, q, dt.p - it.p as diag from dt join it on dt.a = it.a and dt.b = it.b and dt.c = it.c and dt.e = it.e where n >= 15 union
    select r, q, dt.p - it.p from dt join it on dt.a = it.a and n < 15),
same as (select doc_id, item_id, dt.r, it.q, diag, it.p, it.n from cand join it on it.q = cand.q join dt on dt.r = cand.r and dt.p = it.p + diag and dt.a = it.a),
best as (select doc_id, item_id, n, count(*) over (partition by r, q, diag order by p range between current row and 14 following) as c from same)
select doc_id, item_id, cast(max(c) as integer) as best, cast(max(case when n < 15 then n - floor(n * 3 / 15) else 12 end) as integer) as needed
from best where c >= case when n < 15 then n - floor(n * 3 / 15) else 12 end group by doc_id, item_id
"""
