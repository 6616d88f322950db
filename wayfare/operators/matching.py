"""Entity mentions and keyword matching, batched over questions.

Mentions join candidate spans with titles by equality; approximate matches join trigrams, never all pairs. Only what
depends on order within one question (compound keywords) runs in Python, a question at a time.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.text import edit_similarity, fold, heuristic_keywords, trigrams, with_folded
from wayfare.schema import MATCHES, positive, share
from wayfare.sources.cut import kept
from wayfare.sources.graph import Graph


#: Characters of words: letters and numbers of any script, and the underscore.
WORD = r"[\p{L}\p{N}_]"


def _marks(batches):
    """(key, mark, at): each word of a folded text where it begins, and each other sign but blanks, after a zero byte."""
    for batch in batches:
        keys, marks, places = [], [], []
        for key, text in zip(batch["key"].to_pylist(), batch["folded"].to_pylist()):
            begin = -1
            for i, c in enumerate(text or ""):
                if c == "_" or c.isalnum():
                    begin = i if begin < 0 else begin
                    continue
                if begin >= 0:
                    keys.append(key), marks.append(text[begin:i]), places.append(begin)
                    begin = -1
                if not c.isspace():
                    keys.append(key), marks.append("\0" + c), places.append(i)
            if begin >= 0:
                keys.append(key), marks.append(text[begin:]), places.append(begin)
            if len(keys) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(marks, pa.string()), pa.array(places, pa.int32())], ["key", "mark", "at"])
                keys, marks, places = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(marks, pa.string()), pa.array(places, pa.int32())], ["key", "mark", "at"])


def marks(texts: DataFrame) -> DataFrame:
    """(key, mark, at) of (key, folded)."""
    return texts.mapInArrow(_marks, "key string, mark string, at int")


def title_marks(graph: Graph) -> DataFrame:
    """(mark, norm, offset, size): each title under the rarest of its words, or under its first sign where it has none."""
    titles = graph.titles.where("norm <> ''").select(F.sha2("norm", 256).alias("key"), "norm")
    own = marks(titles.withColumnRenamed("norm", "folded"))
    held = own.groupBy("mark").agg(F.count(F.lit(1)).alias("titles"))
    # signs count after all words
    rare = F.struct(F.col("mark").startswith("\0").alias("sign"), F.when(~F.col("mark").startswith("\0"), F.col("titles")).alias("titles"), "at", "mark")
    best = own.join(held, "mark").groupBy("key").agg(F.min(rare).alias("m"))
    return best.join(titles, "key").select(F.col("m.mark").alias("mark"), "norm", F.col("m.at").alias("offset"), F.length("norm").alias("size"))


def title_mentions(graph: Graph, texts: DataFrame) -> DataFrame:
    """(qid, title, node_id, start, end): every title in the folded text of (qid, text) that word boundaries enclose.

    A mention holds its title's words as words, so only words under which titles stand meet them; the title is then
    verified at its place. Work follows the words of texts, whatever the longest title. Rows that share a qid are told apart.
    Texts and their words are merged, never broadcast: their files' bytes, by which that is decided, are a small part of theirs.
    """
    named = with_folded(texts.select(F.col("qid").cast("string").alias("qid"), "text"), "text", "folded").select("qid", F.coalesce("folded", F.lit("")).alias("folded"))
    # equal texts of a question are found once and joined with each of its rows
    named = named.withColumn("key", F.sha2(F.concat_ws("\0", F.coalesce("qid", F.lit("\1")), "folded"), 256))
    met = marks(named.select("key", "folded").distinct()).hint("merge").join(graph.mention_index, "mark").select("key", "norm", "size", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    found = named.hint("merge").join(met, "key")
    inside = F.expr("substring(folded, start + 1, size)") == F.col("norm")
    before = (F.col("start") == 0) | ~F.expr("substring(folded, start, 1)").rlike(WORD)
    after = ~F.expr("substring(folded, start + size + 1, 1)").rlike(WORD)
    found = found.where(inside & before & after).select("qid", "norm", "start", (F.col("start") + F.col("size")).alias("end"))
    return found.join(graph.titles, "norm").select("qid", "title", "node_id", "start", "end")


def local_keywords(graph: Graph, texts: DataFrame) -> DataFrame:
    """(qid, position, keyword, node_id): mentions, longer ones first where they overlap, in the text's order; repeats stay."""
    found = title_mentions(graph, texts)
    item = F.struct((F.col("start") - F.col("end")).alias("less"), "start", "end", "title", "node_id")
    sorted_items = found.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<less:int,start:int,end:int,title:string,node_id:string>>"
    chosen = f"aggregate(items, cast(array() as {kind}), (acc, x) -> if(exists(acc, s -> x.start < s.end and x.end > s.start), acc, array_append(acc, x)))"
    in_order = "array_sort(transform(picked, x -> named_struct('start', x.start, 'title', x.title, 'node_id', x.node_id)))"
    picked = sorted_items.select("qid", F.expr(chosen).alias("picked")).select("qid", F.posexplode(F.expr(in_order)).alias("position", "x"))
    return picked.select("qid", "position", F.col("x.title").alias("keyword"), F.col("x.node_id").alias("node_id"))


def keywords_or_heuristic(graph: Graph, questions: DataFrame) -> DataFrame:
    """(qid, position, keyword) of (qid, question): mentions, and noun-like words only where nothing is mentioned."""
    local = local_keywords(graph, questions.select("qid", F.col("question").alias("text"))).select("qid", "position", "keyword")
    rest = questions.join(local.select("qid").distinct(), "qid", "left_anti")
    return local.unionByName(rest.select("qid", F.posexplode(heuristic_keywords(F.col("question"))).alias("position", "keyword")))


def looked_up(graph: Graph, keywords: DataFrame) -> DataFrame:
    """Adds norm, node_id and the shown title to (qid, position, keyword); null where no title is equal."""
    return with_folded(keywords, "keyword", "norm").join(graph.titles, "norm", "left").select("qid", "position", "keyword", "norm", "node_id", "title")


def exact_match(graph: Graph, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (qid, node_id, position), each once at its first keyword, and unmatched (qid, position, keyword)."""
    found = looked_up(graph, keywords)
    seeds = found.where("node_id is not null").groupBy("qid", "node_id").agg(F.min("position").alias("position"))
    return seeds, found.where("node_id is null").select("qid", "position", "keyword")


#: Postings of a key's trigrams up to which it is joined with all of them at once.
LIGHT = 100_000


def trigram_candidates(graph: Graph, norms: DataFrame, limit: int = 50) -> DataFrame:
    """(key, norm, jaccard, place): the `limit` titles most like each folded text of (key), title order breaking ties.

    Where some key's trigrams are held by many titles (LIGHT), such keys are first joined by the rarer half of them: a title that
    lacks the k rarest of n has a similarity of (n - k) / n at most. If the key's `limit`-th score is above that, it is done; else
    it is joined by all, as light keys are. The result is the same either way. A text under three characters that shares no
    trigram is compared with the first titles in order.
    """
    grams = norms.select("key", trigrams(F.col("key")).alias("g"))
    asked = grams.select("key", F.size("g").alias("n"), F.explode("g").alias("gram")).join(graph.gram_counts, "gram").select("key", "n", "gram", "titles")
    # written, as it is read by both ways, and asked once whether any key needs the longer one
    asked = kept(asked.withColumn("weight", F.sum("titles").over(Window.partitionBy("key"))))
    order = Window.partitionBy("key").orderBy(F.col("jaccard").desc(), "norm")

    def best(pairs: DataFrame) -> DataFrame:
        jaccard = (F.col("both") / (F.col("n") + F.col("n_grams") - F.col("both"))).alias("jaccard")
        return pairs.select("key", "n", "norm", jaccard).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

    def shared(own: DataFrame) -> DataFrame:
        return own.join(graph.postings, "gram").groupBy("key", "n", "norm", "n_grams").agg(F.count(F.lit(1)).alias("both"))

    heavy = asked.where(F.col("weight") > LIGHT)
    if heavy.isEmpty():
        near = best(shared(asked)).select("key", "norm", "jaccard", "place")
    else:
        half = F.ceil(F.col("n") / 2)
        rarest = heavy.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("titles", "gram"))).where(F.col("nth") <= half)
        found = shared(rarest).withColumn("both", F.size(F.array_intersect(trigrams(F.col("key")), trigrams(F.col("norm")))))
        first = kept(best(found))
        sure = first.where((F.col("place") == limit) & (F.col("jaccard") > (F.col("n") - half) / F.col("n"))).select("key")
        rest = asked.where(F.col("weight") <= LIGHT).unionByName(heavy.join(sure, "key", "left_anti"))
        near = best(shared(rest)).unionByName(first.join(sure, "key", "left_semi")).select("key", "norm", "jaccard", "place")
    lost = norms.where(F.length("key") < 3).join(near.select("key").distinct(), "key", "left_anti")
    begin = graph.titles.select("norm").orderBy("norm").limit(limit)
    begin = begin.withColumn("place", F.row_number().over(Window.orderBy("norm")))
    return near.unionByName(lost.crossJoin(F.broadcast(begin)).select("key", "norm", F.lit(0.0).alias("jaccard"), "place"))


def best_titles(graph: Graph, norms: DataFrame, limit: int = 50) -> DataFrame:
    """(key, norm, score, second_score): the best candidate by edit similarity, and the runner-up's score."""
    scored = trigram_candidates(graph, norms, limit).select("key", "norm", edit_similarity(F.col("key"), F.col("norm")).alias("score"))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "norm")
    both = scored.withColumns({"n": F.row_number().over(order), "second_score": F.lead("score").over(order)})
    return both.where("n = 1").select("key", "norm", "score", "second_score")


def accepted(threshold: float | Column, margin: float | Column) -> Column:
    """Whether score and second_score leave no doubt."""
    return F.coalesce((F.col("score") >= threshold) & (F.col("second_score").isNull() | (F.col("score") - F.col("second_score") >= margin)), F.lit(False))


def _question(rows: list[dict], threshold: float, margin: float) -> list[tuple]:
    """The matches of one question's rows: exact ones are given; spans come longest first, a space before a comma."""

    def sure(r: dict) -> bool:
        return r["node_id"] is not None and r["score"] >= threshold and (r["second_score"] is None or r["score"] - r["second_score"] >= margin)

    def match(r: dict, how: str, yes: bool) -> tuple:
        return (r["qid"], r["start"], r["text"], r["node_id"], r["title"], r["score"] if r["node_id"] is not None else 0.0, r["second_score"], how, yes)

    out = {r["start"]: match(r, "exact", True) for r in rows if r["kind"] == "exact"}
    spans: dict[tuple[int, int], list[dict]] = {}
    for r in rows:
        if r["kind"] == "span":
            spans.setdefault((-r["size"], r["start"]), []).append(r)
    used: set[int] = set()
    for (size, start), variants in sorted(spans.items()):
        own = range(start, start - size)
        if used.isdisjoint(own):
            best = max(sorted(variants, key=lambda r: r["variant"]), key=lambda r: r["score"] if r["node_id"] is not None else 0.0)
            if sure(best):
                out[start] = match(best, "approximate-compound", True)
                used.update(own)
    for r in rows:
        if r["kind"] == "single" and r["start"] not in used:
            out[r["start"]] = match(r, "approximate" if sure(r) else "unresolved", sure(r))
    return [out[k] for k in sorted(out)]


def _resolved(batches, controls: list[tuple[float, float]]):
    """Matches of rows that come question by question, under each (threshold, margin)."""
    names = [x.split()[0] for x in MATCHES.split(", ")] + ["threshold", "margin"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.float64(), pa.float64()]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def decided(rows: list[dict]) -> list[tuple]:
        return [(*match, t, m) for t, m in controls for match in _question(rows, t, m)]

    held: list[dict] = []
    for batch in batches:
        found: list[tuple] = []
        for qid, own in groupby(batch.to_pylist(), key=itemgetter("qid")):
            if held and held[0]["qid"] != qid:
                found += decided(held)
                held = []
            held += own
        yield batch_of(found)
    if held:
        yield batch_of(decided(held))


def approximate_match(graph: Graph, keywords: DataFrame, *, threshold: float = 0.85, margin: float = 0.10, candidate_limit: int = 50) -> DataFrame:
    """The match (see MATCHES) of every keyword of (qid, position, keyword).

    Exact titles first; then runs of adjacent unresolved keywords, longest first, joined by a space or a comma and a
    space; then single keywords. A match needs the threshold and, where there is a runner-up, the margin.
    """
    share("match threshold", threshold), share("match margin", margin)
    return matches_by_control(candidate_rows(graph, keywords, candidate_limit), [(threshold, margin)]).drop("threshold", "margin")


def candidate_rows(graph: Graph, keywords: DataFrame, candidate_limit: int = 50) -> DataFrame:
    """What approximate_match decides on: exact titles, single keywords and runs of them, each with its best title and scores."""
    positive("candidate_limit", candidate_limit)
    found = looked_up(graph, keywords)
    texts = "qid string, kind string, start int, size int, variant int, text string, norm string"
    exact = found.where("node_id is not null").selectExpr("qid", "'exact' as kind", "position as start", "1 as size", "0 as variant", "keyword as text", "norm")
    lost = found.where("node_id is null")
    single = lost.selectExpr("qid", "'single' as kind", "position as start", "1 as size", "0 as variant", "keyword as text", "norm")
    # adjacent unresolved keywords have one difference of position and rank
    runs = lost.withColumn("run", F.col("position") - F.row_number().over(Window.partitionBy("qid").orderBy("position")))
    runs = runs.groupBy("qid", "run").agg(F.array_sort(F.collect_list(F.struct("position", "keyword"))).alias("k")).where("size(k) > 1")
    starts = runs.select("qid", "k", F.explode(F.sequence(F.lit(0), F.size("k") - 2)).alias("i"))
    sized = starts.select("qid", "k", "i", F.explode(F.sequence(F.lit(2), F.size("k") - F.col("i"))).alias("size"))
    words = F.expr("transform(slice(k, i + 1, size), x -> x.keyword)")
    spans = sized.select("qid", F.expr("get(k, i).position").alias("start"), "size", words.alias("w"))
    spans = spans.select("qid", "start", "size", F.posexplode(F.array(F.array_join("w", " "), F.array_join("w", ", "))).alias("variant", "text"))
    spans = with_folded(spans, "text", "norm").selectExpr("qid", "'span' as kind", "start", "size", "variant", "text", "norm")
    asked = single.unionByName(spans)
    best = best_titles(graph, asked.select(F.col("norm").alias("key")).distinct(), candidate_limit)
    named = best.join(graph.titles, "norm").select("key", "node_id", "title", "score", "second_score")
    rows = asked.join(named, asked.norm == named.key, "left").drop("key")
    display = graph.nodes.select(F.col("id").alias("node_id"), "title")
    exact = exact.join(graph.titles.select("norm", "node_id"), "norm").join(display, "node_id")
    exact = exact.withColumns({"score": F.lit(1.0), "second_score": F.lit(None).cast("double")})
    columns = [x.split()[0] for x in texts.split(", ")] + ["node_id", "title", "score", "second_score"]
    return rows.select(columns).unionByName(exact.select(columns))


def matches_by_control(rows: DataFrame, controls: list[tuple[float, float]]) -> DataFrame:
    """The matches of candidate_rows under every (threshold, margin), which are further columns."""
    return rows.repartition("qid").sortWithinPartitions("qid").mapInArrow(lambda b: _resolved(b, controls), f"{MATCHES}, threshold double, margin double")


def seeds_of(matches: DataFrame, *by: str) -> DataFrame:
    """(qid, node_id, position) of accepted matches, exact ones before approximate ones; by: further columns that part the matches."""
    order = F.when(F.col("method") == "exact", 0).when(F.col("method") == "approximate-compound", 1).otherwise(2)
    return matches.where("accepted").groupBy("qid", *by, "node_id").agg(F.min(order * 1_000_000 + F.col("position")).alias("position"))


def seeds_by_control(rows: DataFrame, controls: list[tuple[float, float]]) -> DataFrame:
    """(qid, threshold, margin, node_id, position) of candidate_rows."""
    return seeds_of(matches_by_control(rows, controls), "threshold", "margin")


def mentioned_nodes(graph: Graph, texts: DataFrame) -> DataFrame:
    """(qid, node_id, position): nodes whose titles the text of (qid, text) names, each once."""
    return local_keywords(graph, texts).groupBy("qid", "node_id").agg(F.min("position").alias("position"))


def padded_titles(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, id): titles that the folded text holds between spaces, overlaps kept: the page generator's check.

    titles: (id, title). Only runs of the text's words that are titles meet, by equality. A run that a text repeats meets once, so
    pairs need no comparing afterwards unless an id has several titles.
    """
    folded = with_folded(titles.select("id", "title"), "title", "norm").select("id", "norm").distinct()
    longest = folded.agg(F.max(F.size(F.split("norm", " ")))).first()[0] or 0
    words = with_folded(texts.select("qid", "text"), "text", "folded").select("qid", F.split("folded", " ").alias("w"))
    starts = words.select("qid", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("qid", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i") + 1))).alias("n"))
    pieces = runs.select("qid", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("norm"))
    # only runs that are titles go on
    named = pieces.join(folded.select("norm").distinct(), "norm", "left_semi").distinct()
    found = named.join(folded, "norm").select("qid", "id")
    repeated = folded.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found if repeated.isEmpty() else found.distinct()
