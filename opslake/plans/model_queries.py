"""Queries of forests, novelty, templates, supervised models and evidence."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diagnosis, features, forest, novelty, ranking, selection, temporal
from ..operators import evaluate as E
from ..operators import scoring as C
from ..operators import sequence as Q
from ..operators import windows as W
from ..streaming.jobs import new_folder
from . import bindings as B
from . import window_queries as WQ
from .registry import query

R = "round({}, 6)".format
FEATURES = ["p95", "error_fraction", "rps", "max_active"]


def key():
    return F.concat_ws(":", "service", "window")



def changed(spark, d):
    w = B.win(spark, d)
    return W.causal_change(w, ["service"], "window", FEATURES)


CHANGES = [f"{c}_change" for c in FEATURES]


@query("m01_isolation_forest_fit")
def isolation_forest_fit(spark, d):
    return forest.grow(changed(spark, d).where("window < 15"), key(), CHANGES, trees=200, psi=64)


@query("m02_isolation_forest_score")
def isolation_forest_score(spark, d):
    c = changed(spark, d)
    nodes = forest.grow(c.where("window < 15"), key(), CHANGES, trees=200, psi=64)
    return forest.score(c, nodes, CHANGES).select("service", "window", "score")


def forest_scores(spark, d):
    c = changed(spark, d)
    return forest.score(c, forest.grow(c.where("window < 15"), key(), CHANGES, trees=200, psi=64), CHANGES)


@query("m03_service_forests")
def service_forests(spark, d):
    w = B.win(spark, d)
    healthy = w.where("window < 15")
    scaled = w.join(W.mad_reference(healthy, ["service"], FEATURES, [1.0, 0.01, 1.0, 1.0]), "service")
    scaled = scaled.select("service", "window", *[((F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale")).alias(c) for c in FEATURES])
    nodes = forest.grow(scaled.where("window < 15"), key(), FEATURES, F.col("service"), trees=150, psi=64)
    return forest.score(scaled.where("window >= 15"), nodes, FEATURES, F.col("service")).select("service", "window", "score")


@query("m04_session_forest")
def session_forest(spark, d):
    table = new_folder(spark, "sessions")
    WQ.session_pivot(spark, d).write.parquet(table)
    s = spark.read.parquet(table)  # one pivot of the orders; medians, sample and scores read it
    ops = [f"op{i}" for i in range(5)]
    ref = W.mad_reference(s, [], ops, [0.01] * 5, W.GROUP_ROWS)
    x = s.join(F.broadcast(ref)).select("instance", *[F.coalesce((F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale"), F.lit(0.0)).alias(c) for c in ops], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in ops])
    features = [*ops, *[f"{c}_missing" for c in ops]]
    return forest.score(x, forest.grow(x, F.col("instance"), features, trees=200, psi=256), features).select("instance", "score")


TEXT_TERMS = 1500


@query("m05_text_forest")
def text_forest(spark, d):
    """A forest over the weights of the 1,500 most frequent one- and two-word terms, grown on even conversations."""
    t = turns(spark, d)
    counts = novelty.terms(t, ["q"], "text")
    healthy = F.floor(F.col("q") / 1000) % 2 == 0
    idf = novelty.tfidf_fit(counts.where(healthy), "q", TEXT_TERMS)
    x = t.select("q").join(novelty.sparse_vectors(counts, idf, "q"), "q", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<i:int,v:double>>")))
    nodes = forest.grow(x.where(healthy), F.col("q"), F.col("x"), trees=120, psi=256, size=TEXT_TERMS)
    return forest.score(x, nodes, F.col("x"), size=TEXT_TERMS).select("q", "score")


@query("m29_forest_introspection")
def forest_introspection(spark, d):
    return forest.introspect(isolation_forest_fit(spark, d))


@query("m26_historical_replay")
def historical_replay(spark, d):
    scored = isolation_forest_score(spark, d)
    limit = scored.where("window < 15").agg(F.percentile("score", F.lit(0.995)).alias("threshold"))
    ranked = Q.top_k(scored, ["window"], [F.col("score").desc(), F.col("service")], 5)
    top = ranked.groupBy("window").agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "service"))), lambda x: x["service"]).alias("candidates"))
    return top.join(F.broadcast(limit)).withColumn("alert", F.col("score") > F.col("threshold"))


@query("m26_replay_changes")
def replay_changes(spark, d):
    """Each day's score against the healthy threshold, its five first candidates and the three most changed features of each."""
    scored = forest_scores(spark, d)
    threshold = ranking.quantiles(scored.where("window < 15"), "score", [0.995]).withColumnRenamed("q0", "threshold")
    out = E.replay(scored, threshold, ["window"], FEATURES)
    one = lambda c: F.concat_ws(":", c["service"], F.array_join(F.transform(c["changes"], lambda x: x["feature"]), "+"))
    return out.select("window", "score", "threshold", "alert", F.array_join(F.transform("candidates", one), ",").alias("candidates"))


@query("m29_forest_report")
def forest_report(spark, d):
    """Splits, least and greatest value of the training rows by service and feature, and the service's threshold."""
    c = changed(spark, d)
    train = c.where("window < 15")
    nodes = forest.grow(train, key(), CHANGES, F.col("service"), trees=100, psi=64)
    table = new_folder(spark, "nodes")
    nodes.write.parquet(table)
    nodes = spark.read.parquet(table)
    return forest.report(nodes, train, forest.score(train, nodes, CHANGES, F.col("service")), CHANGES, F.col("service"))


@query("p14_modality_drop")
def modality_drop(spark, d):
    c = changed(spark, d)
    nodes = forest.grow(c.where("window < 15"), key(), CHANGES, trees=100, psi=64)
    whole = forest.score(c, nodes, CHANGES)
    dropped = whole.withColumn("error_fraction_change", F.lit(0.0))
    return forest.score(dropped, nodes, CHANGES, name="without_errors").select("service", "window", "score", "without_errors")


_TERMS = """cut AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS w FROM %s),
grams AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM cut),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)"""
_IDF = "idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 30000))"
_BENCH = "(SELECT item_id AS doc_id, text FROM benchmark)"


def prototypes(spark, d):
    return B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query("m06_tfidf_fit", f"WITH {_TERMS % _BENCH}, {_IDF} SELECT term, {R('idf')} AS idf FROM idf")
def tfidf_fit(spark, d):
    return novelty.tfidf_fit(novelty.terms(prototypes(spark, d), ["doc_id"], "text"), "doc_id")


_NOVEL = f"""{_TERMS % _BENCH}, {_IDF}, pw AS (SELECT doc_id AS p, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), pn AS (SELECT p, term, w / sqrt(sum(w * w) OVER (PARTITION BY p)) AS w FROM pw),
{(_TERMS % '(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)').replace('cut ', 'qcut ').replace('FROM cut', 'FROM qcut').replace('grams ', 'qgrams ').replace('FROM grams', 'FROM qgrams').replace('tf AS (SELECT', 'qtf AS (SELECT')},
qw AS (SELECT doc_id AS q, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)), qn AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qw),
best AS (SELECT q, 1 - max(c) AS novelty FROM (SELECT q, p, sum(qn.w * pn.w) AS c FROM qn JOIN pn USING (term) GROUP BY q, p) GROUP BY q)"""


def turns(spark, d):
    return B.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), "text")


@query("m07_lexical_novelty", f"WITH {_NOVEL} SELECT conv_id * 1000 + turn AS q, {R('coalesce(novelty, 1.0)')} AS novelty FROM conversations LEFT JOIN best ON q = conv_id * 1000 + turn")
def lexical_novelty(spark, d):
    return novelty.lexical_novelty(turns(spark, d), "q", "text", prototypes(spark, d), "doc_id", "text")


@query("j17_nearest_prototype", f"WITH {_NOVEL} SELECT q, {R('novelty')} AS novelty FROM best")
def nearest_prototype(spark, d):
    seen = novelty.terms(prototypes(spark, d), ["doc_id"], "text")
    idf = novelty.tfidf_fit(seen, "doc_id")
    queries = novelty.tfidf_weights(novelty.terms(turns(spark, d), ["q"], "text"), idf, "q")
    blocks = novelty.entry_blocks(turns(spark, d), "text"), novelty.entry_blocks(prototypes(spark, d), "text")
    return novelty.nearest(queries, novelty.tfidf_weights(seen, idf, "doc_id"), "q", "doc_id", *blocks)


@query(
    "m09_drift_findings",
    f"""WITH {_NOVEL}, e AS (SELECT CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'other' END AS service, conv_id // 10 AS "window", coalesce(novelty, 1.0) > 0.5 AS novel FROM conversations LEFT JOIN best ON q = conv_id * 1000 + turn),
p AS (SELECT service, "window", count(*) AS events, count(*) FILTER (novel) AS novel FROM e GROUP BY ALL), f AS (SELECT *, events >= 5 AND novel > 0.1 * events AS active FROM p)
SELECT service, "window", events, novel, active, active AND coalesce(lag(active) OVER (PARTITION BY service ORDER BY "window"), false) AS finding FROM f""",
)
def drift_findings(spark, d):
    scored = lexical_novelty(spark, d)
    e = scored.select(F.when(F.col("q") % 1000 % 2 == 0, "user").otherwise("other").alias("service"), F.floor(F.floor(F.col("q") / 1000) / 10).alias("window"), "novelty")
    return novelty.drift_findings(e, 0.5, least_events=5)


@query(
    "m08_vector_novelty",
    f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r AS (SELECT v FROM e WHERE label <= 4)
SELECT vec_id, {R('1 - max(list_cosine_similarity(e.v, r.v))')} AS novelty FROM e, r WHERE label > 4 GROUP BY vec_id""",
)
def vector_novelty(spark, d):
    return novelty.vector_novelty(B.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") <= 4)


@query("m10_template_mining")
def template_mining(spark, d):
    return novelty.mine_templates(B.table(spark, d, "pages").select(F.translate("url", "/?&=#.", "      ").alias("line")), "line")


@query("m10_unseen_templates")
def unseen_templates(spark, d):
    lines = B.table(spark, d, "pages").select("page_id", F.translate("url", "/?&=#.", "      ").alias("line"))
    known = novelty.mine_templates(lines.where("page_id % 3 <> 0"), "line")
    return novelty.match_templates(lines.where("page_id % 3 = 0"), "line", known).select("page_id", "known")


@query(
    "m11_window_vector",
    f"""WITH {B.REQ} SELECT "window", service, count(*) AS n, {R('avg(coalesce(CAST(status = 503 AS INT), 0))')} AS error_fraction, {R('avg(coalesce(CAST(status = 404 AS INT), 0))')} AS warn_fraction,
  {R('quantile_cont(duration, 0.95)')} AS p95, {R('avg(CAST(status IS NULL AS INT))')} AS unknown_fraction FROM req GROUP BY ALL""",
)
def window_vector(spark, d):
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    s = F.col("status")
    return B.req(spark, d).groupBy("window", "service").agg(F.count(F.lit(1)).alias("n"), share(s == 503).alias("error_fraction"), share(s == 404).alias("warn_fraction"), F.percentile("duration", F.lit(0.95)).alias("p95"), share(s.isNull()).alias("unknown_fraction"))


@query(
    "o07_distinct_map_back",
    "WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '[0-9]+', '<num>', 'g') AS template FROM conversations) SELECT conv_id, turn, count(*) OVER (PARTITION BY template) AS copies, length(template) AS size FROM t",
)
def distinct_map_back(spark, d):
    """Each distinct template is measured once, and what was found goes back to every row that has it."""
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[0-9]+", "<num>").alias("template"))
    scored = rows.groupBy("template").agg(F.count(F.lit(1)).alias("copies")).withColumn("size", F.length("template").cast("long"))
    return rows.join(scored, "template").select("conv_id", "turn", "copies", "size")


@query("f01_log_template")
def log_template(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.log_template(F.col("url")).alias("template"))


def training(spark, d):
    """Context features of every service-window with a truth from the schedule, and weights that balance the classes."""
    rows = W.context_features(B.busy(spark, d).drop("base", "until"), ["window"], FEATURES)
    labelled = rows.join(F.broadcast(B.schedule(spark)), "service", "left").withColumn("truth", F.coalesce((F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")), F.lit(False)).cast("double"))
    share = labelled.agg((F.count_if(F.col("truth") == 0) / F.greatest(F.count_if(F.col("truth") == 1), F.lit(1))).alias("_s"))
    return labelled.join(F.broadcast(share)).withColumn("weight", F.when(F.col("truth") == 1, F.col("_s")).otherwise(1.0))


def boosted(train, rows, columns, iterations=20, depth=4):
    """rows with ``score`` from boosted trees fitted on train (truth, weight)."""
    pack = VectorAssembler(inputCols=columns, outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="truth", weightCol="weight", maxIter=iterations, maxDepth=depth, seed=7).fit(pack.transform(train))
    return model.transform(pack.transform(rows)).withColumn("score", vector_to_array("probability")[1])


COLUMNS = [f"{c}_{k}" for c in FEATURES for k in ("log", "mean", "max")]


@query("m13_supervised_detector")
def supervised_detector(spark, d):
    rows = training(spark, d)
    return boosted(rows.where("window % 2 = 0"), rows, COLUMNS).select("service", "window", "truth", "score")


@query("m14_service_ranker")
def service_ranker(spark, d):
    rows = training(spark, d)
    faulty = rows.where("truth = 1").select("window").distinct()
    scored = boosted(rows.join(faulty, "window", "left_semi"), rows, COLUMNS)
    return Q.top_k(scored.select("service", "window", "score"), ["window"], [F.col("score").desc(), F.col("service")], 3)


@query("m15_temporal_detector")
def temporal_detector(spark, d):
    rows = training(spark, d)
    steps = W.history(B.win(spark, d), ["service"], "window", ["p95", "error_fraction"])
    wide = steps.select("service", "window", *[F.col(f"{c}_history")[i].alias(f"{c}_{i}") for c in ("p95", "error_fraction") for i in range(5)])
    joined = rows.join(wide, ["service", "window"])
    columns = [*COLUMNS, *[f"{c}_{i}" for c in ("p95", "error_fraction") for i in range(5)]]
    scored = boosted(joined.where("window % 2 = 0"), joined, columns)
    return scored.select("service", "window", F.when(F.col("requests") > 0, F.col("score")).alias("score"))


SELECTION_FEATURES = [f"{c}_{k}" for c in ("p95", "error_fraction") for k in ("log", "mean", "max")]


def candidates(train, rows, columns):
    """Scored rows of logistic regressions from strong to weak penalty, each fitted when it is asked for."""
    for penalty in (10.0, 1.0, 0.1, 0.01, 0.001, 0.0):
        pack = VectorAssembler(inputCols=columns, outputCol="x")
        fit = LogisticRegression(featuresCol="x", labelCol="truth", weightCol="weight", regParam=penalty, maxIter=30)
        model = fit.fit(pack.transform(train))
        yield f"penalty {penalty:g}", model.transform(pack.transform(rows)).withColumn("score", vector_to_array("probability")[1])


@query("m16_model_selection")
def model_selection(spark, d):
    """Fitted on even days, chosen by average precision and first rank on the odd ones."""
    rows = training(spark, d).cache()
    validation = rows.where("window % 2 = 1")
    return selection.select_model(candidates(rows.where("window % 2 = 0"), validation, SELECTION_FEATURES), "window", "service")


@query("m30_modality_dropout", f"WITH {B.WIN} SELECT service, \"window\", CAST(CAST('0x' || substr(sha256(service || ':' || \"window\"), 1, 4) AS BIGINT) % 100 < 15 AS INT) AS hide_errors FROM win")
def modality_dropout(spark, d):
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "service", F.col("window").cast("string")), 256), 1, 4), 16, 10).cast("long")
    return B.win(spark, d).select("service", "window", (h % 100 < 15).cast("int").alias("hide_errors"))


_CONTEXT = f"""{WQ._REASONS}, {WQ._EVIDENCE}, e AS (SELECT *, row_number() OVER (PARTITION BY service, "window" ORDER BY coalesce(status >= 400, false) DESC, duration DESC, span) AS i FROM ev)"""


@query(
    "m22_evidence_context",
    f"""WITH {_CONTEXT} SELECT "window", service, 'E' || row_number() OVER (PARTITION BY "window" ORDER BY service, i) AS evidence, span,
  CASE WHEN status >= 400 AND dependency IS NULL THEN 'local_error' WHEN status >= 400 THEN 'dependency' WHEN duration > 100 THEN 'latency' ELSE 'none' END AS runbook
FROM e WHERE i <= 2 AND "window" >= 15""",
)
def evidence_context(spark, d):
    ev = WQ.with_priority(spark, d).select("window", "service", F.posexplode(F.slice("evidence", 1, 2)).alias("i", "e"))
    number = F.row_number().over(Window.partitionBy("window").orderBy("service", "i"))
    bad = F.coalesce(F.col("e.status") >= 400, F.lit(False))
    runbook = F.when(bad & F.col("e.dependency").isNull(), "local_error").when(bad, "dependency").when(F.col("e.duration") > 100, "latency").otherwise("none")
    return ev.select("window", "service", F.concat(F.lit("E"), number.cast("string")).alias("evidence"), "e.span", runbook.alias("runbook"))


@query(
    "m23_diagnosis_validation",
    f"""WITH {_CONTEXT}, t AS (SELECT DISTINCT span, service, "window" FROM ev WHERE "window" >= 15),
dx AS (SELECT span + 0 AS span, service, "window", CASE WHEN k % 5 = 0 THEN 'clear' ELSE 'review' END AS verdict, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN span + 1 ELSE span END AS cited FROM req WHERE "window" >= 15)
SELECT dx.span, CASE WHEN verdict = 'clear' AND s.alert THEN 'clear against an alert' WHEN verdict = 'review' AND t.span IS NULL THEN 'unknown citation' WHEN verdict = 'review' AND t.service <> dx.service THEN 'unrelated citation' WHEN verdict = 'review' AND NOT s.alert THEN 'review without an alert' ELSE 'accepted' END AS outcome
FROM dx LEFT JOIN t ON t.span = dx.cited JOIN (SELECT service, "window", slow OR failing AS alert FROM scored) s ON s.service = dx.service AND s."window" = dx."window" """,
)
def diagnosis_validation(spark, d):
    p = WQ.with_priority(spark, d)
    known = p.select(F.explode("evidence").alias("e"), F.col("service").alias("owner")).select(F.col("e.span").alias("cited"), "owner")
    k = F.col("k")
    dx = B.req(spark, d).where("window >= 15").select("span", "service", "window", F.when(k % 5 == 0, "clear").otherwise("review").alias("verdict"), F.when(k % 5 == 0, None).when(k % 7 == 0, F.col("span") + 1).otherwise(F.col("span")).alias("cited"))
    j = dx.join(known, "cited", "left").join(p.select("service", "window", "alert"), ["service", "window"])
    review = F.col("verdict") == "review"
    reason = C.reject_reason([(~review & F.col("alert"), "clear against an alert"), (review & F.col("owner").isNull(), "unknown citation"), (review & (F.col("owner") != F.col("service")), "unrelated citation"), (review & ~F.col("alert"), "review without an alert")])
    return j.select("span", F.coalesce(reason, F.lit("accepted")).alias("outcome"))


@query(
    "m21_reference_features",
    f"""WITH {B.WIN}, r AS (SELECT service, quantile_cont(p95, 0.5) AS c, greatest(stddev_pop(p95), abs(quantile_cont(p95, 0.5)) * 0.05, 1e-6) AS s FROM win WHERE "window" < 15 AND service <> 'view' GROUP BY service)
SELECT service, "window", CASE WHEN c IS NULL THEN 0.0 ELSE {R('least(abs(p95 - c) / s, 100)')} END AS p95_change, CAST(c IS NULL AS INT) AS missing FROM win LEFT JOIN r USING (service)""",
)
def reference_features(spark, d):
    from ..functions.scalar import clipped_change

    w = B.win(spark, d)
    r = W.healthy_reference(w.where("window < 15 AND service <> 'view'"), ["service"], ["p95"])
    j = w.join(r, "service", "left")
    return j.select("service", "window", clipped_change(F.col("p95"), F.col("p95_center"), F.col("p95_scale")).alias("p95_change"), F.col("p95_center").isNull().cast("int").alias("missing"))


# A prediction is a user's day with the five services as candidates; a day without any request has only absent ones.
_PREDICTIONS = f"""{B.REQ}, calls AS (SELECT stream, "window", service, span, status, duration, CASE WHEN k % 3 = 0 THEN 'view' END AS dependency FROM req),
grid AS (SELECT stream, "window", service, place FROM (SELECT DISTINCT stream FROM req), (SELECT unnest(range(30)) AS "window"), (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5)) v(service, place)),
cand AS (SELECT g.stream, g."window", g.service, place, count(span) AS requests, coalesce(bool_or(coalesce(status >= 400, false) OR duration > 150), false) AS warned FROM grid g LEFT JOIN calls c USING (stream, "window", service) GROUP BY ALL),
pred AS (SELECT stream, "window", bool_or(warned) OR sum(requests) = 0 AS alert, sum(requests) = 0 AS absent, bool_or(requests = 0) AS some_absent FROM cand GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream, "window", service ORDER BY coalesce(status >= 400, false) DESC, duration DESC, span) AS i FROM calls) WHERE i <= 2),
e AS (SELECT stream, "window", 'E' || row_number() OVER (PARTITION BY stream, "window" ORDER BY place, i) AS id, service, dependency, coalesce(status >= 400, false) AS failed, duration > 100 AS slow FROM tops JOIN cand USING (stream, "window", service)),
m AS (SELECT stream, "window", 'M' || place AS id, service FROM cand),
books AS (SELECT stream, "window", any_value(some_absent) AS coverage, coalesce(bool_or(failed AND dependency IS NOT NULL), false) AS dependency, coalesce(bool_or(slow), false) AS latency, coalesce(bool_or(failed AND dependency IS NULL), false) AS local_error, count(id) AS n FROM pred LEFT JOIN e USING (stream, "window") GROUP BY ALL)"""


def prediction_contexts(spark, d):
    calls = WQ.with_dependency(B.req(spark, d)).select("stream", "window", "service", "span", "status", "duration", "dependency")
    names = ["click", "error", "purchase", "signup", "view"]
    grid = W.spine(calls.select("stream").distinct(), 0, B.DAYS - 1).withColumn("service", F.explode(F.array(*[F.lit(n) for n in names])))
    warned = F.coalesce(F.col("status") >= 400, F.lit(False)) | (F.col("duration") > 150)
    per = calls.groupBy("stream", "window", "service").agg(F.count(F.lit(1)).alias("requests"), F.bool_or(warned).alias("warned"))
    cells = grid.join(per, ["stream", "window", "service"], "left").fillna(0, ["requests"])
    idle = F.sum("requests").over(Window.partitionBy("stream", "window")) == 0  # five rows
    candidates = cells.select("stream", "window", "service", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("service")).alias("place"), "requests", (F.coalesce("warned", F.lit(False)) | idle).alias("alert"))
    return diagnosis.contexts(candidates, calls, ["stream", "window"])


@query(
    "m22_prediction_context",
    f"""WITH {_PREDICTIONS} SELECT pred.stream, pred."window", n AS evidence, n + 5 AS citations,
  array_to_string(list_filter([CASE WHEN coverage THEN 'coverage' END, CASE WHEN dependency THEN 'dependency' END, CASE WHEN latency THEN 'latency' END, CASE WHEN local_error THEN 'local_error' END, 'none'], lambda x: x IS NOT NULL), ',') AS runbooks,
  alert, absent, (SELECT string_agg(id || ':' || service || ':' || coalesce(dependency, ''), ',' ORDER BY CAST(substr(id, 2) AS INT)) FROM e WHERE e.stream = pred.stream AND e."window" = pred."window") AS cited
FROM pred JOIN books USING (stream, "window")""",
)
def prediction_context(spark, d):
    """The citations E1.. and M1.., supported runbooks, and flags of each prediction."""
    c = prediction_contexts(spark, d)
    own = F.filter("citations", lambda x: x["id"].startswith("E"))
    text = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["id"], x["service"], F.coalesce(x["dependency"], F.lit("")))), ",")
    return c.select("stream", "window", F.size(own).cast("long").alias("evidence"), F.size("citations").cast("long").alias("citations"), F.array_join("runbooks", ",").alias("runbooks"), "alert", "absent", F.when(F.size(own) > 0, text).alias("cited"))


#: status, service, citations, runbook of the answer that a prediction gets by its number; the last is no answer at all.
_ANSWERS = [
    ("review", None, [], "none"), ("clear", "view", [], "none"), ("review", None, ["E1", "E1"], "none"), ("review", None, ["E99"], "none"), ("review", "ghost", ["M1"], "none"), ("review", None, ["M1"], "dependency"),
    ("review", "view", ["M1"], "none"), ("clear", None, [], "none"), ("review", "error", ["M2"], "none"), ("abstain", None, [], "none"), ("review", None, ["E1"], "latency"), ("review", "click", ["M1"], "coverage"), None,
]
_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_ANSWER_ROWS = ", ".join(f"({i}, {_quoted(a[0])}, {_quoted(a[1])}, CAST([{', '.join(map(_quoted, a[2]))}] AS VARCHAR[]), {_quoted(a[3])})" for i, a in enumerate(_ANSWERS) if a)


@query(
    "m23_all_rejections",
    f"""WITH {_PREDICTIONS}, given AS (SELECT * FROM (VALUES {_ANSWER_ROWS}) v(h, status, named, ids, book)),
dx AS (SELECT p.*, status, named, ids, book, n, coverage, dependency, latency, local_error FROM pred p LEFT JOIN given ON h = (p.stream * 7 + p."window") % 13 JOIN books USING (stream, "window")),
cites AS (SELECT stream, "window", named, unnest(ids) AS id FROM dx WHERE named IS NOT NULL),
rel AS (SELECT c.stream, c."window", bool_or(coalesce(e.service = named, false) OR coalesce(e.dependency = named, false) OR coalesce(m.service = named, false)) AS related FROM cites c
  LEFT JOIN e ON e.stream = c.stream AND e."window" = c."window" AND e.id = c.id LEFT JOIN m ON m.stream = c.stream AND m."window" = c."window" AND m.id = c.id GROUP BY ALL),
judged AS (SELECT dx.stream, dx."window", status, CASE WHEN status IS NULL THEN 'malformed' WHEN status = 'review' AND len(ids) = 0 THEN 'review without citation'
  WHEN status = 'clear' AND (named IS NOT NULL OR book <> 'none') THEN 'clear naming a fault' WHEN len(list_distinct(ids)) < len(ids) THEN 'duplicate citation'
  WHEN len(list_filter(ids, lambda x: (x[1] = 'E' AND CAST(substr(x, 2) AS INT) > n) OR (x[1] = 'M' AND CAST(substr(x, 2) AS INT) > 5))) > 0 THEN 'unknown citation'
  WHEN named = 'ghost' THEN 'unknown service' WHEN NOT CASE book WHEN 'none' THEN true WHEN 'coverage' THEN coverage WHEN 'dependency' THEN dependency WHEN 'latency' THEN latency ELSE local_error END THEN 'runbook not available'
  WHEN named IS NOT NULL AND len(ids) > 0 AND NOT related THEN 'unrelated citation' WHEN status = 'clear' AND alert THEN 'clear against an alert' WHEN status = 'review' AND NOT alert THEN 'review without an alert'
  WHEN status = 'review' AND absent THEN 'review of absent sources' END AS reason FROM dx LEFT JOIN rel USING (stream, "window"))
SELECT stream, "window", reason IS NULL AS accepted, CASE WHEN reason IS NULL THEN status ELSE 'abstain' END AS status, reason FROM judged""",
)
def all_rejections(spark, d):
    """A diagnosis for every prediction, in JSON; each of the eleven rejections occurs."""
    known = prediction_contexts(spark, d)
    h = (F.col("stream") * 7 + F.col("window")) % 13
    answer = F.lit('{"status": "review", "evidence')
    for i, a in enumerate(_ANSWERS):
        if a:
            made = F.to_json(F.struct(F.lit(a[0]).alias("status"), F.lit(a[1]).cast("string").alias("suspected_service"), F.array(*[F.lit(x) for x in a[2]]).cast("array<string>").alias("evidence_ids"), F.lit(a[3]).alias("runbook_id"), F.lit("seen").alias("summary")))
            answer = F.when(h == i, made).otherwise(answer)
    return diagnosis.validated(known.select("stream", "window", answer.alias("answer")), known, ["stream", "window"])


def _page_lines(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.coalesce(F.translate("url", "/?&=#.", "      "), F.lit("")).alias("line"))


_PAGE_LINES = "SELECT page_id, page_id % 3 = 0 AS fresh, trim(translate(coalesce(url, ''), '/?&=#.', '      ')) AS line FROM pages"


def _tree_sql(children=novelty.TREE_CHILDREN, lines=_PAGE_LINES):
    """The tree of two thirds of the lines, unrolled: l_i has every line with its path to level i, k_i the kept words."""
    word = lambda i: f"CASE WHEN len(w) > {i} AND NOT regexp_matches(w[{i + 1}], '[0-9]') THEN w[{i + 1}] ELSE '<*>' END"
    out = [f"cut AS (SELECT page_id, fresh, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM ({lines}))", "l_0 AS (SELECT *, CAST(len(w) AS VARCHAR) AS p FROM cut)"]
    for i in range(novelty.TREE_DEPTH):
        out.append(f"k_{i} AS (SELECT p, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, x) AS r FROM (SELECT p, {word(i)} AS x FROM l_{i} WHERE NOT fresh) WHERE x <> '<*>' GROUP BY p, x) WHERE r <= {children})")
        out.append(f"l_{i + 1} AS (SELECT page_id, fresh, w, l.p || ' ' || coalesce(k.x, '<*>') AS p FROM l_{i} l LEFT JOIN k_{i} k ON k.p = l.p AND k.x = {word(i)})")
    last = f"l_{novelty.TREE_DEPTH}"
    out.append(f"places AS (SELECT p, i, CASE WHEN min(w[i]) = max(w[i]) AND NOT regexp_matches(min(w[i]), '[0-9]') THEN min(w[i]) ELSE '<*>' END AS word, count(*) AS n FROM (SELECT p, w, unnest(range(1, len(w) + 1)) AS i FROM {last} WHERE NOT fresh) GROUP BY p, i)")
    out.append("leaves AS (SELECT p, list(word ORDER BY i) AS words, max(n) AS n FROM places GROUP BY p)")
    out.append(f"matched AS (SELECT page_id, leaves.p AS leaf, leaves.p IS NOT NULL AND len(list_filter(range(1, len(w) + 1), lambda i: words[i] <> '<*>' AND words[i] <> w[i])) = 0 AS known FROM {last} l LEFT JOIN leaves ON leaves.p = l.p WHERE fresh)")
    return ", ".join(out)


@query("m10_template_tree", f"WITH {_tree_sql()} SELECT p AS path, array_to_string(words, ' ') AS template, n FROM leaves")
def template_tree(spark, d):
    """Templates by a prefix tree that is made of counts alone."""
    tree = novelty.TemplateTree(_page_lines(spark, d).where("page_id % 3 <> 0"), "line")
    return tree.templates.select("path", F.array_join("words", " ").alias("template"), "n")


@query("m10_unknown_share", f"WITH {_tree_sql()} SELECT page_id // 50 AS \"window\", count(*) AS lines, {R('avg(CAST(NOT known AS INT))')} AS unknown, avg(CAST(NOT known AS INT)) > 0.1 AS drifted FROM matched GROUP BY 1")
def unknown_share(spark, d):
    """The share of new lines that no frozen template knows, by window."""
    lines = _page_lines(spark, d)
    tree = novelty.TemplateTree(lines.where("page_id % 3 <> 0"), "line")
    matched = tree.match(lines.where("page_id % 3 = 0"), "line").withColumn("window", F.floor(F.col("page_id") / 50))
    return novelty.unknown_share(matched, ["window"])


# Three sources from the requests: metrics from every fifth, logs from every fourth, spans from those over 60. Nobody knows
# how signup behaves when healthy, nor how many lines view writes.
_EXTERNAL = f"""{B.REQ}, m AS (SELECT service, "window", avg(duration) AS r0, avg(active) AS r1 FROM req WHERE k % 5 = 0 GROUP BY ALL),
l AS (SELECT service, "window", ln(1 + count(*)) AS r8, avg(coalesce(CAST(status >= 400 AS INT), 0)) AS r9 FROM req WHERE k % 4 = 1 GROUP BY ALL),
t AS (SELECT service, "window", ln(1 + count(*)) AS r10, avg(duration) AS r11, max(duration) AS r12, count(*) FILTER (status <> 200) / nullif(count(status), 0) AS r13, count(status) / count(*) AS known FROM req WHERE k > 60 OR k = 3 GROUP BY ALL),
raw AS (SELECT service, "window", r0, r1, r8, r9, r10, r11, r12, r13, known FROM (SELECT DISTINCT service FROM req) CROSS JOIN (SELECT unnest(range(30)) AS "window") LEFT JOIN m USING (service, "window") LEFT JOIN l USING (service, "window") LEFT JOIN t USING (service, "window")),
ref AS (SELECT service, {', '.join(f"quantile_cont(r{i}, 0.5) AS c{i}, greatest(stddev_pop(r{i}), abs(quantile_cont(r{i}, 0.5)) * 0.05, 1e-6) AS s{i}" for i in (0, 1, 8, 9, 10, 11, 12, 13))}
  FROM (SELECT * REPLACE (CASE WHEN service <> 'view' THEN r8 END AS r8, CASE WHEN service <> 'view' THEN r9 END AS r9) FROM raw WHERE "window" < 8 AND service <> 'signup') GROUP BY service),
ch AS (SELECT raw.service, "window", coalesce(known, 0) AS known, r8 IS NOT NULL AND c8 IS NOT NULL AND c9 IS NOT NULL AS logs, r10 IS NOT NULL AND c10 IS NOT NULL AND c11 IS NOT NULL AND c12 IS NOT NULL AS spans,
  (6 + CAST(r0 + c0 IS NULL AS INT) + CAST(r1 + c1 IS NULL AS INT)) / 8 AS missing, {', '.join(f"least(coalesce(abs(r{i} - c{i}) / s{i}, 0), 100) AS d{i}" for i in (0, 1, 8, 9, 10, 11, 12, 13))} FROM raw LEFT JOIN ref USING (service))"""
_EXTERNAL_COLUMNS = [
    "d0", "d1", *["0.0"] * 6, "CASE WHEN logs THEN d8 ELSE 0 END", "CASE WHEN logs THEN d9 ELSE 0 END", "CAST(logs AS INT)",
    *[f"CASE WHEN spans THEN d{i} ELSE 0 END" for i in (10, 11, 12, 13)], "CAST(spans AS INT)", "CASE WHEN spans THEN known ELSE 0 END", "missing",
]


def external_features(spark, d):
    r, keys, k = B.req(spark, d), ["service", "window"], F.col("k")
    grid = W.spine(r.select("service").distinct(), 0, B.DAYS - 1)
    metrics = r.where(k % 5 == 0).select(*keys, F.stack(F.lit(2), F.lit("cpu"), F.col("duration"), F.lit("mem"), F.col("active").cast("double")).alias("kind", "value"))
    logs = r.where(k % 4 == 1).select(*keys, F.coalesce(F.col("status") >= 400, F.lit(False)).alias("error"))
    raw = features.raw_dimensions(grid, metrics, logs, r.where((k > 60) | (k == 3)), keys, ["cpu", "mem"])
    healthy = raw.where("window < 8 AND service <> 'signup'").withColumns({c: F.when(F.col("service") != "view", F.col(c)) for c in ("r8", "r9")})
    return features.scaled_features(raw, features.reference_dimensions(healthy, ["service"]), keys, ["service"])


@query("m21_external_features", f"""WITH {_EXTERNAL} SELECT service, "window", {', '.join(f"round(CAST({c} AS DOUBLE), 6) AS f{i}" for i, c in enumerate(_EXTERNAL_COLUMNS))} FROM ch""")
def external_feature_columns(spark, d):
    """All 18 features of every service-day, of which 14 are changes against the healthy reference."""
    return external_features(spark, d).select("service", "window", *[F.col("features")[i].alias(f"f{i}") for i in range(features.FEATURES)])


def temporal_items(spark, d):
    """A day is an item: five days of features of each service, whether it has a source, and the faulty ones."""
    h = features.histories(external_features(spark, d), ["service"], "window", temporal.HISTORY)
    h = h.join(F.broadcast(B.schedule(spark)), "service", "left").withColumn("fault", F.coalesce((F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")), F.lit(False)))
    return temporal.items(h, ["window"], F.col("fault"), F.col("fault"), features.observed(F.col("features")))


@query("m15_temporal_fusion")
def temporal_fusion(spark, d):
    """Detection and ranking of each day with all sources, without logs and without traces, fitted on two days in three."""
    data = temporal_items(spark, d)
    model = temporal.fit(data, F.col("window") % 3 == 2, F.col("window"), epochs=10, folder=new_folder(spark, "items"))
    out = temporal.predict(data, model, ["window"]).select("window", "score", F.array_join(F.slice("ranking", 1, 3), ",").alias("top"), (F.size("ranking") == 0).alias("abstained"))
    for source in ("logs", "traces"):
        out = out.join(temporal.predict(data, model, ["window"], drop=source).select("window", F.col("score").alias(f"without_{source}")), "window")
    return out


# Log lines of the requests. During a service's fault every third has words that healthy days never had; some are marks of
# the tool that injects faults, which are left out.
_LINES = f"""{B.REQ}, {B.SCHED}, lines AS (SELECT service, "window", span, end_s, duration, status, CASE WHEN status IS NULL THEN 'fault injection marker ' || span
  WHEN "window" >= onset AND "window" < recovery AND k % 3 = 0 THEN 'panic shard lock poisoned in ' || service || ' flush ' || k WHEN status >= 400 THEN 'request ' || service || ' failed with status ' || status || ' after ' || span
  ELSE 'request ' || service || ' served ' || ['alpha', 'beta', 'gamma', 'delta', 'omega'][1 + k % 5] || ' in ' || span || ' steps' END AS message FROM req LEFT JOIN sched USING (service)),
ev AS (SELECT *, lower(regexp_replace(message, '[0-9]+', '<num>', 'g')) AS template FROM lines WHERE message NOT LIKE 'fault%')"""


def log_lines(spark, d):
    r = B.req(spark, d).join(F.broadcast(B.schedule(spark)), "service", "left")
    k, span = F.col("k"), F.col("span").cast("string")
    word = F.get(F.array(*[F.lit(w) for w in ("alpha", "beta", "gamma", "delta", "omega")]), k % 5)
    message = (
        F.when(F.col("status").isNull(), F.concat(F.lit("fault injection marker "), span))
        .when((F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")) & (k % 3 == 0), F.concat(F.lit("panic shard lock poisoned in "), "service", F.lit(" flush "), k.cast("string")))
        .when(F.col("status") >= 400, F.concat(F.lit("request "), "service", F.lit(" failed with status "), F.col("status").cast("string"), F.lit(" after "), span))
        .otherwise(F.concat(F.lit("request "), "service", F.lit(" served "), word, F.lit(" in "), span, F.lit(" steps")))
    )
    return r.select("service", "window", "span", "end_s", "duration", "status", message.alias("message")).withColumn("template", T.log_template(F.col("message")))


_DRIFT = f"""{_LINES}, {_TERMS % "(SELECT DISTINCT template AS doc_id, template AS text FROM ev WHERE \"window\" < 5)"}, {_IDF}, pw AS (SELECT doc_id AS p, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), pn AS (SELECT p, term, w / sqrt(sum(w * w) OVER (PARTITION BY p)) AS w FROM pw),
{(_TERMS % '(SELECT DISTINCT template AS doc_id, template AS text FROM ev)').replace('cut ', 'qcut ').replace('FROM cut', 'FROM qcut').replace('grams ', 'qgrams ').replace('FROM grams', 'FROM qgrams').replace('tf AS (SELECT', 'qtf AS (SELECT')},
qw AS (SELECT doc_id AS q, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)), qn AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qw),
best AS (SELECT q, 1 - max(c) AS novelty FROM (SELECT q, p, sum(qn.w * pn.w) AS c FROM qn JOIN pn USING (term) GROUP BY q, p) GROUP BY q),
scored AS (SELECT ev.*, coalesce(novelty, 1.0) AS novelty FROM ev LEFT JOIN best ON q = template),
lim AS (SELECT greatest(quantile_cont(novelty, 0.995), 0.05) AS threshold FROM scored WHERE "window" IN (5, 6, 7)),
per AS (SELECT s.service, w."window", count(e.span) AS events, count(*) FILTER (e.novelty > threshold) AS novel FROM (SELECT DISTINCT service FROM ev) s CROSS JOIN (SELECT unnest(range(0, 30)) AS "window") w CROSS JOIN lim LEFT JOIN scored e ON e.service = s.service AND e."window" = w."window" GROUP BY ALL),
act AS (SELECT *, events >= 20 AND novel > 0.1 * events AS active FROM per),
found AS (SELECT * FROM (SELECT *, active AND coalesce(lag(active) OVER (PARTITION BY service ORDER BY "window"), false) AS finding FROM act) WHERE finding)"""


def content_drift(spark, d):
    """Log lines; how many there are by service, day, template and whether a mark of the injector excludes them; those of the
    events with their template's novelty; the threshold. The lines are read once."""
    lines = log_lines(spark, d).withColumn("excluded", T.is_instrumentation(F.col("message")))
    counts = novelty.template_counts(lines, ["service", "window", "excluded"], "template", new_folder(spark, "counts"))
    events = counts.where(~F.col("excluded"))
    scored = novelty.template_novelty(events, "template", events.where("window < 5"), new_folder(spark, "templates"))
    return lines, counts, scored, novelty.novelty_threshold(scored.where("window BETWEEN 5 AND 7"), n="n")


@query(
    "m09_calibrated_drift",
    f"""WITH {_DRIFT}, r AS (SELECT e.*, row_number() OVER (PARTITION BY e.service, e."window" ORDER BY round(novelty, 9) DESC, span, message) AS i FROM scored e JOIN found USING (service, "window") CROSS JOIN lim WHERE novelty > threshold)
SELECT service, "window", any_value(events) AS events, any_value(novel) AS novel, {R('any_value(novel / events)')} AS share, string_agg(substr(sha256(service || ':' || span || ':' || message), 1, 20) || ' ' || round(novelty, 6), ',' ORDER BY i) AS evidence
FROM r JOIN found USING (service, "window") WHERE i <= 3 GROUP BY service, "window" """,
)
def calibrated_drift(spark, d):
    """Days whose messages drift from those of the first five, by a threshold of the next three, with the three most novel."""
    lines, _, scored, threshold = content_drift(spark, d)
    events = lines.where(~F.col("excluded")).withColumnRenamed("span", "time")
    found = novelty.template_evidence(events, "template", scored, threshold, (0, B.DAYS - 1), new_folder(spark, "findings"))
    text = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["id"], F.round(e["novelty"], 6).cast("string"))), ",")
    return found.select("service", "window", "events", "novel", "share", text.alias("evidence"))


@query(
    "a30_content_summary",
    f"""WITH {_DRIFT}, c AS (SELECT "window" // 10 AS "case", count(*) AS events, count(DISTINCT template) AS templates FROM ev GROUP BY 1), x AS (SELECT "window" // 10 AS "case", count(*) AS excluded FROM lines WHERE message LIKE 'fault%' GROUP BY 1),
f AS (SELECT "window" // 10 AS "case", count(*) AS warnings, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM found GROUP BY 1)
SELECT "case", coalesce(warnings, 0) AS warnings, events, coalesce(excluded, 0) AS excluded, templates, coalesce(services, '') AS services FROM c LEFT JOIN x USING ("case") LEFT JOIN f USING ("case")""",
)
def content_summary(spark, d):
    """Ten days are a case: its warnings and their services, events with and without marks of the injector, templates."""
    _, counts, scored, threshold = content_drift(spark, d)
    found = novelty.drift_windows(scored, threshold, (0, B.DAYS - 1), n="n")
    counts, found = (x.withColumn("case", F.floor(F.col("window") / 10)) for x in (counts, found))
    out = novelty.content_summary(counts.where(~F.col("excluded")), counts.where("excluded"), found, "template", ["case"], "n")
    return out.withColumn("services", F.array_join("services", ","))


_LINE_TREE = "SELECT span AS page_id, \"window\" >= 8 AS fresh, template AS line FROM ev"


@query(
    "m11_template_shares",
    f"""WITH {_LINES}, {_tree_sql(lines=_LINE_TREE)}, n AS (SELECT service, "window", count(*) AS lines, avg(CAST(NOT known AS INT)) AS unknown FROM matched JOIN ev ON span = page_id GROUP BY ALL),
c AS (SELECT service, "window", leaf, count(*) AS n FROM matched JOIN ev ON span = page_id WHERE known GROUP BY ALL)
SELECT n.service, n."window", any_value(lines) AS lines, {R('any_value(unknown)')} AS unknown, string_agg(CAST(CAST(round(coalesce(c.n, 0) / lines * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY leaves.p) AS shares
FROM n CROSS JOIN leaves LEFT JOIN c ON c.service = n.service AND c."window" = n."window" AND c.leaf = leaves.p GROUP BY n.service, n."window" """,
)
def window_template_shares(spark, d):
    """The part of a window's vector that counts templates: shares, in millionths, of those of the first eight days."""
    events = log_lines(spark, d).where(~T.is_instrumentation(F.col("message")))
    tree = novelty.TemplateTree(events.where("window < 8"), "template")
    out = novelty.template_shares(tree.match(events.where("window >= 8"), "template", "path"), tree, ["service", "window"])
    return out.withColumn("shares", F.array_join(F.transform("shares", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ","))


@query(
    "m18_window_status",
    f"""WITH {_LINES}, known AS (SELECT DISTINCT template FROM ev WHERE "window" < 5),
c AS (SELECT CAST(floor(end_s / 3600) AS BIGINT) AS slot, service, count(*) AS events, count(*) FILTER (status >= 500) AS errors, quantile_cont(duration, 0.95) AS p95, avg(CAST(known.template IS NULL AS INT)) AS unknown FROM ev LEFT JOIN known USING (template) GROUP BY ALL),
sc AS (SELECT slot, max(p95) AS score FROM c GROUP BY slot), lim AS (SELECT quantile_cont(score, 0.95) AS threshold FROM sc WHERE slot < 473352 + 192),
w AS (SELECT slot, list(service) AS there, bool_or(unknown > 0.1) AS novel, coalesce(bool_or(service = 'purchase' AND errors > 0), false) AS r1, coalesce(bool_or(service = 'view' AND errors > 0), false) AS r2, coalesce(bool_or(service = 'purchase' AND p95 > 150), false) AS r3 FROM c GROUP BY slot),
o AS (SELECT slot, score > threshold AS ml_anomaly, novel, r1, r2, r3, list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(there, x)) AS missing FROM sc JOIN w USING (slot) CROSS JOIN lim),
s AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'insufficient_telemetry' WHEN ml_anomaly OR novel THEN 'anomaly' ELSE 'normal' END AS status FROM o)
SELECT slot, status, ml_anomaly, novel, array_to_string(missing, ',') AS missing, CASE WHEN status = 'anomaly' THEN CASE WHEN r1 THEN 'purchase' WHEN r2 THEN 'view' WHEN r3 THEN 'purchase' END END AS suspect FROM s""",
)
def window_status(spark, d):
    """Hours by their logs: levels, latency and unknown templates by service; purchase is the store that others wait for."""
    lines = log_lines(spark, d)
    events = lines.where(~T.is_instrumentation(F.col("message"))).withColumn("slot", F.floor(F.col("end_s") / 3600))
    known = events.where("window < 5").select(F.col("template").alias("_known")).distinct()
    marked = events.join(known, F.col("template") == F.col("_known"), "left")
    per = marked.groupBy("slot", "service").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") >= 500).alias("errors"), F.percentile("duration", F.lit(0.95)).alias("p95"), F.avg(F.col("_known").isNull().cast("double")).alias("unknown"))
    scores = per.groupBy("slot").agg(F.max("p95").alias("score"))
    threshold = ranking.quantiles(scores.where("slot < 473352 + 192"), "score", [0.95]).withColumnRenamed("q0", "threshold")
    rules = [("purchase", F.col("errors") > 0, "purchase"), ("view", F.col("errors") > 0, "view"), ("purchase", F.col("p95") > 150, "purchase")]
    out = C.window_status(per, scores, threshold, ["click", "error", "purchase", "signup", "view"], rules, window="slot")
    return out.withColumn("missing", F.array_join("missing", ","))
