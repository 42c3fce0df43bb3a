"""Text and vector novelty: weights of terms, distance to the nearest prototype, findings; template mining."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import evidence_id
from .ranking import quantiles
from .sequence import streaks

ROUTE_LINES = 20_000
BLOCK_CHARS = 1 << 20
#: Products of weights, or cosines, that a task holds at once.
PRODUCTS = 1 << 22


def terms(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, term, tf: one- and two-word terms of lower-case words of two or more letters or digits."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    w = df.select(*ids, words.alias("_w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1)))
    each = F.concat(F.col("_w"), F.when(F.size("_w") >= 2, pairs).otherwise(F.array().cast("array<string>")))
    return w.select(*ids, F.explode(each).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_fit(counts: DataFrame, key: str, limit: int = 30_000) -> DataFrame:
    """term, idf of the ``limit`` terms with the largest corpus frequency (ties by term): ln((1 + n) / (1 + df)) + 1."""
    n = counts.agg(F.count_distinct(key).alias("n"))
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).orderBy(F.col("cf").desc(), "term").limit(limit)
    return per_term.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, term, w: (1 + ln tf) * idf, each text scaled to length 1."""
    raw = counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "term", "w")


def sparse_vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """key, x: each text's weights as a sparse vector (array of i, v) over the terms of idf in their order."""
    numbered = idf.withColumn("_i", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))  # as many rows as idf has terms
    weights = tfidf_weights(counts, idf, key).join(F.broadcast(numbered.select("term", "_i")), "term")
    return weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("w").alias("v")))).alias("x"))


def entry_blocks(texts: DataFrame, text: str) -> int:
    """Into how many blocks the texts' terms go, at about ``BLOCK_CHARS`` characters of text a block."""
    return max(1, -(-(texts.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS))


def nearest(queries: DataFrame, prototypes: DataFrame, query_key: str, prototype_key: str, query_blocks: int = 1, prototype_blocks: int = 1) -> DataFrame:
    """query_key, novelty: 1 - the largest cosine with a prototype, over the texts that share a term with one.

    Both sides are cut into blocks of whole texts. A task multiplies a block of queries with a block of prototypes as
    sparse matrices and keeps each query's largest cosine, so no row ever stands for a query and a prototype, and a term
    that all texts have is nothing special. The blocks' largest cosines are taken over blocks."""
    entries = lambda df, key, n, name: df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(f"_{name}")).agg(F.collect_list(F.struct(F.col(key).alias("k"), "term", "w")).alias(f"_{name}s"))
    asked, known = entries(queries, query_key, query_blocks, "q"), entries(prototypes, prototype_key, prototype_blocks, "p")
    pairs = block_pairs(asked, known, "_q", "_p", query_blocks, prototype_blocks).select("_qs", "_ps")
    kind = queries.schema[query_key].dataType

    def closest(batches):
        for batch in batches:
            for q, p in zip(batch.column("_qs"), batch.column("_ps")):
                keys, cosine = _largest_cosines(q.values, p.values)
                yield pa.record_batch([keys, pa.array(cosine)], ["_key", "_c"])

    found = pairs.mapInArrow(closest, T.StructType([T.StructField("_key", kind), T.StructField("_c", T.DoubleType())]))
    return found.groupBy(F.col("_key").alias(query_key)).agg((1 - F.max("_c")).alias("novelty"))


def block_pairs(asked: DataFrame, known: DataFrame, q: str, p: str, query_blocks: int, prototype_blocks: int) -> DataFrame:
    """Every block of queries with every block of prototypes. Few prototypes are few blocks, and a join by their number alone
    would bring all queries into as few tasks: each is repeated for as many parts of the queries as there are tasks."""
    parts = min(query_blocks, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = asked.withColumns({p: F.explode(F.sequence(F.lit(0), F.lit(prototype_blocks - 1))), "_part": F.pmod(F.col(q), F.lit(parts)).cast("int")})
    return left.join(known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [p, "_part"])


def _largest_cosines(queries: pa.StructArray, prototypes: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The keys of the queries that share a term with a prototype, and their largest sums of products of weights."""
    of = [prototypes.field(c) for c in ("k", "term", "w")]
    vocabulary = of[1].dictionary_encode()
    term, p = vocabulary.indices.to_numpy(), of[0].dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    p, w = p[order], of[2].to_numpy()[order]
    first = np.searchsorted(term[order], np.arange(len(vocabulary.dictionary) + 1))
    there = pc.index_in(queries.field("term"), value_set=vocabulary.dictionary)
    shared = there.is_valid().to_numpy(zero_copy_only=False)
    keys = queries.field("k").filter(pa.array(shared)).dictionary_encode()
    t, q = there.drop_null().to_numpy(), keys.indices.to_numpy()
    u = queries.field("w").to_numpy()[shared]
    by = np.argsort(q, kind="stable")
    t, q, u = t[by], q[by], u[by]
    n, m = len(keys.dictionary), int(p.max(initial=-1)) + 1
    out = np.zeros(n)
    hits = first[t + 1] - first[t]
    ends, total = np.searchsorted(q, np.arange(n + 1)), np.append(0, np.cumsum(hits))
    at = 0
    while at < n:  # as many queries at once as their products and their row of cosines fit
        upto = max(at + 1, min(n, at + PRODUCTS // max(1, m), int(np.searchsorted(total[ends], total[ends[at]] + PRODUCTS, "right")) - 1))
        rows = slice(ends[at], ends[upto])
        size = hits[rows]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[t[rows]], size)
        cell = np.repeat((q[rows] - at) * m, size) + p[inside]
        sums = np.bincount(cell, np.repeat(u[rows], size) * w[inside], minlength=(upto - at) * m)
        out[at:upto] = sums.reshape(upto - at, m).max(axis=1)
        at = upto
    return keys.dictionary, out


def lexical_novelty(texts: DataFrame, key: str, text: str, prototypes: DataFrame, prototype_key: str, prototype_text: str, limit: int = 30_000) -> DataFrame:
    """key, novelty of every text; one without any known term has novelty 1."""
    seen = terms(prototypes, [prototype_key], prototype_text)
    idf = tfidf_fit(seen, prototype_key, limit)
    blocks = entry_blocks(texts, text), entry_blocks(prototypes, prototype_text)
    scored = nearest(tfidf_weights(terms(texts, [key], text), idf, key), tfidf_weights(seen, idf, prototype_key), key, prototype_key, *blocks)
    return texts.select(key).join(scored, key, "left").select(key, F.coalesce("novelty", F.lit(1.0)).alias("novelty"))


def vector_novelty(df: DataFrame, key: str, vector: str, is_reference: Column, block: int = 4096) -> DataFrame:
    """key, novelty of the rows that are no reference: 1 - the largest cosine to a reference vector, 2 without any.

    Both sides are packed into blocks of about ``block`` vectors, each block of one side meets each of the other in a task
    as one matrix product, and the largest cosines are taken over the blocks. Nothing passes through the driver. Equal
    reference vectors count once."""
    references = df.where(is_reference).select(F.col(vector).alias("v")).distinct()
    queries = df.where(~is_reference).select(F.col(key).alias("_key"), F.col(vector).alias("v"))
    blocks = lambda rows: max(1, -(-rows.count() // block))
    n_references, n_queries = blocks(references), blocks(queries)
    packed = references.groupBy(F.pmod(F.xxhash64("v"), F.lit(n_references)).cast("int").alias("_b")).agg(F.collect_list("v").alias("_r"))
    asked = queries.withColumn("_q", F.pmod(F.monotonically_increasing_id(), F.lit(n_queries))).groupBy("_q").agg(F.collect_list(F.struct("_key", "v")).alias("_rows"))
    pairs = block_pairs(asked, packed, "_q", "_b", n_queries, n_references).select("_rows", "_r")
    kind = queries.schema["_key"].dataType

    def closest(batches):
        for batch in batches:
            for rows, against in zip(batch.column("_rows"), batch.column("_r")):
                x, r = _unit([e["v"] for e in rows.as_py()]), _unit(against.as_py())
                yield pa.record_batch([rows.values.field("_key"), pa.array((x @ r.T).max(axis=1))], ["_key", "_c"])

    found = pairs.mapInArrow(closest, T.StructType([T.StructField("_key", kind), T.StructField("_c", T.DoubleType())]))
    best = found.groupBy("_key").agg(F.max("_c").alias("_c"))
    joined = queries.select("_key").join(best, "_key", "left")
    return joined.select(F.col("_key").alias(key), (1 - F.coalesce("_c", F.lit(-1.0))).alias("novelty"))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def drift_findings(events: DataFrame, threshold: float | Column, least_events: int = 20, least_share: float = 0.1, windows: tuple[int, int] | None = None, n: str | None = None) -> DataFrame:
    """service, window, events, novel, active, finding from rows (service, window, novelty): a window is active with enough
    events of which more than ``least_share`` are novel; a finding is the second active window in a row or a later one. ``n``:
    the column with the number of events that a row stands for."""
    one = F.col(n) if n else F.lit(1)
    per = events.groupBy("service", "window").agg(F.sum(one).alias("events"), F.sum(F.when(F.col("novelty") > threshold, one).otherwise(0)).alias("novel"))
    if windows:
        grid = per.select("service").distinct().withColumn("window", F.explode(F.sequence(F.lit(windows[0]).cast("long"), F.lit(windows[1]).cast("long"))))
        per = grid.join(per, ["service", "window"], "left").fillna(0, ["events", "novel"])
    per = per.withColumn("active", (F.col("events") >= least_events) & (F.col("novel") > least_share * F.col("events")))
    return streaks(per, ["service"], "window", "active").withColumn("finding", F.col("streak") >= 2).drop("streak")


def template_counts(events: DataFrame, keys: list[str], template: str, folder: str) -> DataFrame:
    """keys, template, n: how many events each template has in each key, written to ``folder``. Templates are few where events are
    many: what follows from an event's template alone is found from these rows, and the events are read once."""
    events.groupBy(*keys, template).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(folder)
    return events.sparkSession.read.parquet(folder)


def template_novelty(events: DataFrame, template: str, prototypes: DataFrame, folder: str | None = None) -> DataFrame:
    """events with ``novelty``: each distinct template is compared once with the distinct templates of ``prototypes``. With a
    ``folder`` the templates' novelty is written there, so what reads the events more than once compares them once."""
    known = prototypes.select(F.col(template).alias("_p")).distinct().where("_p IS NOT NULL").select("_p", F.col("_p").alias("_text"))
    asked = events.select(F.col(template).alias("_t")).distinct().where("_t IS NOT NULL").select("_t", F.col("_t").alias("_text"))
    scored = lexical_novelty(asked, "_t", "_text", known, "_p", "_text")
    if folder:
        scored.write.mode("overwrite").parquet(folder)
        scored = events.sparkSession.read.parquet(folder)
    return events.join(scored, F.col(template) == F.col("_t"), "left").drop("_t").withColumn("novelty", F.coalesce("novelty", F.lit(1.0)))


def novelty_threshold(healthy: DataFrame, share: float = 0.995, least: float = 0.05, n: str | None = None) -> DataFrame:
    """One row with the threshold: the quantile of the healthy events' novelty, and no less than ``least``. ``n`` as in
    :func:`drift_findings`."""
    return quantiles(healthy, "novelty", [share], n).select(F.greatest(F.coalesce("q0", F.lit(least)), F.lit(least)).alias("threshold"))


def drift_windows(events: DataFrame, threshold: DataFrame, windows: tuple[int, int], least_events: int = 20, least_share: float = 0.1, n: str | None = None) -> DataFrame:
    """service, window, events, novel, share of every finding, from rows (service, window, novelty). ``n`` as in
    :func:`drift_findings`."""
    found = drift_findings(events.join(F.broadcast(threshold)), F.col("threshold"), least_events, least_share, windows, n)
    return found.where("finding").select("service", "window", "events", "novel", (F.col("novel") / F.col("events")).alias("share"))


def drift_evidence(events: DataFrame, threshold: DataFrame, windows: tuple[int, int], least_events: int = 20, least_share: float = 0.1, k: int = 3) -> DataFrame:
    """service, window, events, novel, share, evidence of every finding, from rows (service, window, time, message, novelty): its
    ``k`` most novel events (of equal ones the earliest, then by message) as an array of novelty, time, message (600
    characters) and an id. Only findings' events are ranked, and a task keeps k of a window before they are shuffled."""
    found = drift_windows(events, threshold, windows, least_events, least_share)
    novel = events.join(F.broadcast(threshold)).where("novelty > threshold").join(found.select("service", "window"), ["service", "window"], "left_semi")
    return found.join(_most_novel(novel, k), ["service", "window"])


def template_evidence(events: DataFrame, template: str, counts: DataFrame, threshold: DataFrame, windows: tuple[int, int], folder: str, least_events: int = 20, least_share: float = 0.1, k: int = 3) -> DataFrame:
    """:func:`drift_evidence` of events (service, window, time, message, template) whose novelty follows from their template, from
    ``counts`` (service, window, template, n, novelty). Findings are made of counts, their novel templates are written to
    ``folder`` (so the planner knows their size), and events are read for the evidence alone."""
    found = drift_windows(counts, threshold, windows, least_events, least_share, "n")
    counts.join(F.broadcast(threshold)).where("novelty > threshold").join(found, ["service", "window"]).select(*found.columns, F.col(template).alias("_t"), "novelty").write.mode("overwrite").parquet(folder)
    cells = events.sparkSession.read.parquet(folder)
    found = cells.select(*found.columns).distinct()
    near = events.join(found, ["service", "window"], "left_semi")
    of = cells.select(F.col("service").alias("_s"), F.col("window").alias("_w"), "_t", "novelty")
    novel = near.join(of, (F.col("service") == F.col("_s")) & (F.col("window") == F.col("_w")) & F.col(template).eqNullSafe(F.col("_t")))
    return found.join(_most_novel(novel, k), ["service", "window"])


def _most_novel(novel: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("service", "window").orderBy(F.round("novelty", 9).desc(), "time", "message"))
    top = novel.withColumn("_r", place).where(F.col("_r") <= k)
    one = F.struct("_r", "novelty", "time", F.substring("message", 1, 600).alias("message"), evidence_id("service", "time", "message").alias("id"))
    return top.groupBy("service", "window").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("_r")).alias("evidence"))


def content_summary(events: DataFrame, excluded: DataFrame, findings: DataFrame, template: str, keys: list[str], n: str | None = None) -> DataFrame:
    """keys, warnings (service-windows with a finding), services (names with one), events, excluded (events left out), templates
    (distinct ones) of each case. ``n``: the column of events and excluded as in :func:`drift_findings`."""
    one = F.col(n) if n else F.lit(1)
    counts = events.groupBy(*keys, template).agg(F.sum(one).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("events"), F.count(template).alias("templates"))
    out = excluded.groupBy(*keys).agg(F.sum(one).alias("excluded"))
    warned = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("warnings"), F.array_sort(F.collect_set("service")).alias("services"))
    joined = counts.join(out, keys, "full").join(warned, keys, "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("warnings", "events", "excluded", "templates")], F.coalesce("services", F.array().cast("array<string>")).alias("services"))


def mine_templates(df: DataFrame, text: str, leading: int = 2, similarity: float = 0.6) -> DataFrame:
    """route, template, n: texts of one route (number of words and leading words without digits) are clustered in the order
    of the text; a text joins the most similar template and masks where they differ, or begins a new one. Only distinct
    texts are clustered, so repeated lines cost one row. A route with over ``ROUTE_LINES`` distinct texts is clustered in
    parts of about that many, and then the parts' templates are."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    first = F.transform(F.slice(words, 1, leading), lambda w: F.when(w.rlike(r"\d"), "<*>").otherwise(w))
    routed = df.select(F.concat_ws(" ", F.size(words).cast("string"), F.concat_ws(" ", first)).alias("route"), F.col(text).alias("text")).groupBy("route", "text").agg(F.count(F.lit(1)).alias("n"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for line, n in pdf.sort_values("text")[["text", "n"]].itertuples(index=False):
            parts = line.split()
            same = [sum(a == b or a == "<*>" for a, b in zip(t, parts)) / max(1, len(parts)) for t, _ in found]
            if same and max(same) >= similarity:
                at = same.index(max(same))
                found[at][0] = [a if a == b else "<*>" for a, b in zip(found[at][0], parts)]
                found[at][1] += n
            else:
                found.append([parts, n])
        return pd.DataFrame({"route": pdf["route"].iloc[0], "template": [" ".join(t) for t, _ in found], "n": [int(n) for _, n in found]})

    schema = "route string, template string, n long"
    sizes = routed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / ROUTE_LINES).cast("int").alias("_parts"))
    dealt = routed.join(sizes, "route").withColumn("_part", F.pmod(F.xxhash64("text"), F.col("_parts")).cast("int"))
    found = dealt.groupBy("route", "_part", "_parts").applyInPandas(lambda pdf: cluster(pdf).assign(parts=pdf["_parts"].iloc[0]), schema + ", parts int")
    merged = found.where("parts > 1").groupBy("route", F.col("template").alias("text")).agg(F.sum("n").alias("n")).groupBy("route").applyInPandas(cluster, schema)
    return found.where("parts = 1").drop("parts").unionByName(merged)


def match_templates(df: DataFrame, text: str, templates: DataFrame, leading: int = 2, similarity: float = 0.6) -> DataFrame:
    """df with ``known``: whether a frozen template of the text's route is similar enough. Templates are never added."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    first = F.transform(F.slice(words, 1, leading), lambda w: F.when(w.rlike(r"\d"), "<*>").otherwise(w))
    routed = df.withColumn("_words", words).withColumn("_route", F.concat_ws(" ", F.size(words).cast("string"), F.concat_ws(" ", first)))
    lists = templates.groupBy(F.col("route").alias("_r")).agg(F.collect_list(F.split("template", " ")).alias("_t"))
    alike = lambda t: F.size(F.filter(F.zip_with(t, F.col("_words"), lambda a, b: (a == b) | (a == "<*>")), lambda x: x)) >= similarity * F.size("_words")
    joined = routed.join(lists, routed["_route"] == lists["_r"], "left")
    return joined.withColumn("known", F.coalesce(F.exists("_t", alike), F.lit(False))).drop("_words", "_route", "_r", "_t")


#: Words at the front of a line that make its path in the template tree, and literal children of a node.
TREE_DEPTH, TREE_CHILDREN = 3, 16
MASK = "<*>"


class TemplateTree:
    """Templates of lines as a prefix tree of fixed depth: the root's children are numbers of words, each level below one more
    leading word. A node keeps its ``children`` most frequent words (of equal ones the first; words with digits never)
    and sends all others to one masked child; a leaf's template keeps the words without digits that all its lines share.

    Every step is a count or a least and greatest word, so parts of the lines can be counted anywhere and added up, and the
    tree does not depend on the order or the partitions of lines. It is at most lengths * (children + 1) ^ depth leaves."""

    def __init__(self, lines: DataFrame, text: str, depth: int = TREE_DEPTH, children: int = TREE_CHILDREN):
        self.depth, self.levels = depth, []
        rows = _words(lines.groupBy(F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_n")), "_text")
        for i in range(depth):
            counts = rows.select("_path", _word(i).alias("_word"), "_n").where(F.col("_word") != MASK).groupBy("_path", "_word").agg(F.sum("_n").alias("_n"))
            order = Window.partitionBy("_path").orderBy(F.col("_n").desc(), "_word")
            self.levels.append(counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= children).select("_path", "_word"))
            rows = _descend(rows, self.levels[i], i)
        at = rows.select("_path", "_n", F.posexplode("_w").alias("_i", "_word")).groupBy("_path", "_i").agg(F.min("_word").alias("_a"), F.max("_word").alias("_z"), F.sum("_n").alias("_n"))
        word = F.when((F.col("_a") == F.col("_z")) & ~F.col("_a").rlike("[0-9]"), F.col("_a")).otherwise(MASK)
        leaf = at.groupBy("_path").agg(F.array_sort(F.collect_list(F.struct("_i", word.alias("w")))).alias("_t"), F.max("_n").alias("n"))  # as many as a line has words
        self.templates = leaf.select(F.col("_path").alias("path"), F.transform("_t", lambda t: t["w"]).alias("words"), "n")

    def match(self, df: DataFrame, text: str, path: str | None = None) -> DataFrame:
        """df with ``known``: whether its line's leaf is in the tree and has the line's words where it keeps words, and if named
        with that leaf's ``path`` (null if it is not known). Nothing is added to the tree."""
        rows = _words(df, text)
        for i, kept in enumerate(self.levels):
            rows = _descend(rows, kept, i)
        leaves = self.templates.select(F.col("path").alias("_leaf"), F.col("words").alias("_template"))
        same = F.forall(F.zip_with("_template", "_w", lambda t, w: (t == MASK) | (t == w)), lambda x: x)
        joined = rows.join(leaves, F.col("_path") == F.col("_leaf"), "left")
        out = joined.withColumn("known", F.coalesce(same, F.lit(False)))
        if path:
            out = out.withColumn(path, F.when(F.col("known"), F.col("_leaf")))
        return out.drop("_w", "_path", "_leaf", "_template")


def _words(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")
    return df.withColumn("_w", F.coalesce(words, F.array().cast("array<string>"))).withColumn("_path", F.size("_w").cast("string"))


def _word(i: int) -> Column:
    w = F.get("_w", F.lit(i))
    return F.when(w.isNull() | w.rlike("[0-9]"), MASK).otherwise(w)


def _descend(rows: DataFrame, kept: DataFrame, i: int) -> DataFrame:
    names = rows.columns
    marked = rows.withColumn("_next", _word(i))
    level = kept.select(F.col("_path").alias("_kp"), F.col("_word").alias("_kw"))
    joined = marked.join(level, (F.col("_path") == F.col("_kp")) & (F.col("_next") == F.col("_kw")), "left")
    return joined.withColumn("_path", F.concat_ws(" ", "_path", F.coalesce("_kw", F.lit(MASK)))).select(*names)


def unknown_share(df: DataFrame, keys: list[str], limit: float = 0.1) -> DataFrame:
    """keys, lines, unknown (share of lines without a known template), drifted: whether that is over the limit."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.avg((~F.col("known")).cast("double")).alias("unknown"))
    return per.withColumn("drifted", F.col("unknown") > limit)


def template_shares(matched: DataFrame, tree: TemplateTree, keys: list[str], path: str = "path") -> DataFrame:
    """keys, lines, unknown and ``shares``: of each of the tree's templates, in the order of paths, its share of the key's lines
    (a template is a dimension of the vector, so one that the key lacks is 0). matched has keys and ``path``."""
    counts = matched.groupBy(*keys, F.col(path).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(*keys).agg(F.sum("_n").alias("lines"), F.sum(F.when(F.col("_p").isNull(), F.col("_n")).otherwise(0)).alias("_new"), F.map_from_entries(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_n")))).alias("_of"))
    paths = tree.templates.agg(F.array_sort(F.collect_list("path")).alias("_paths"))  # bounded by the tree
    share = lambda p: F.coalesce(F.try_element_at("_of", p), F.lit(0)) / F.col("lines")
    return per.join(F.broadcast(paths)).select(*keys, "lines", (F.col("_new") / F.col("lines")).alias("unknown"), F.transform("_paths", share).alias("shares"))
