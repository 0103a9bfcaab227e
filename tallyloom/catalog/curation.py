"""Curation and evaluation queries over documents, labels, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scope
from ..operators import curation, evaluation
from .registry import query

_SHA = "sha1(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
_N = "count(*) FILTER ({0})".format
_ROWS = f"r AS (SELECT doc_id AS id, {_SHA} AS sha, quality AS label, toxic, lang, source, n_chars, text FROM documents JOIN labels USING (doc_id))"
_RESOLVED = f"{_ROWS}, c AS (SELECT sha, max(label) AS label, arg_min(id, struct_pack(a := -label, b := id)) AS id FROM r GROUP BY 1)"
_SPLIT = f"{_RESOLVED}, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY sha) <= greatest(1, CAST(floor(count(*) OVER () * 0.32) AS BIGINT)) THEN 'eval' ELSE 'train' END AS part FROM c)"
_SCORED = "e AS (SELECT doc_id AS id, toxic AS want, CAST((doc_id * 37 + toxic * 40) % 100 AS DOUBLE) / 100 AS p, CASE WHEN (doc_id * 37 + toxic * 40) % 100 >= 50 THEN 1 ELSE 0 END AS got, lang, source, n_chars FROM documents JOIN labels USING (doc_id))"
_CONF = f"{_N('w AND g')} AS tp, {_N('w AND NOT g')} AS fn, {_N('NOT w AND g')} AS fp, {_N('NOT w AND NOT g')} AS tn"
_RATES = "tp, fn, fp, tn, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn + fp + tn > 0 THEN (tp + tn) / (tp + fn + fp + tn) END AS accuracy"


def _labelled(t):
    rows = t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic", "lang", "source", "n_chars", "text")
    return curation.hashed(rows)


def _resolved(t):
    return curation.resolve_conflicts(_labelled(t))


def _scored(t):
    x = (F.col("doc_id") * 37 + F.col("toxic") * 40) % 100
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("want"), (x.cast("double") / 100).alias("p"), (x >= 50).cast("int").alias("got"), "lang", "source", "n_chars")


@query("whitespace_norm_sha1", f"SELECT doc_id, {_SHA} AS sha FROM documents")
def _(t):
    return curation.hashed(t("documents")).select("doc_id", "sha")


@query("dedup_conflict_secret_wins", f"WITH {_RESOLVED} SELECT * FROM c")
def _(t):
    return _resolved(t)


@query("deterministic_split", f"WITH {_SPLIT} SELECT sha, label, id, part FROM s")
def _(t):
    return curation.split(_resolved(t))


@query(
    "apply_label_override",
    f"WITH {_SPLIT}, h AS (SELECT sha, 1 - label AS human FROM c WHERE id % 9 = 0 UNION ALL SELECT 'unseen', 1) SELECT coalesce(s.sha, h.sha) AS sha, coalesce(human, label) AS label, CASE WHEN human IS NOT NULL THEN 'train' ELSE part END AS part FROM s FULL JOIN h ON s.sha = h.sha",
)
def _(t):
    rows = curation.split(_resolved(t))
    human = rows.where("id % 9 = 0").select("sha", (1 - F.col("label")).alias("human"))
    human = human.union(human.sparkSession.createDataFrame([("unseen", 1)], "sha string, human int"))
    return curation.override_labels(rows, human)


@query("hard_weight", f"WITH {_SPLIT} SELECT sha, label, part, unnest(range(1, CASE WHEN id % 5 = 0 THEN 5 ELSE 2 END)) AS copy FROM s WHERE id % 5 <> 0 OR part = 'train'")
def _(t):
    rows = curation.split(_resolved(t))
    return curation.weight_hard(rows, rows.where("id % 5 = 0")).withColumn("copy", F.col("copy").cast("long"))


@query(
    "balance_downsample",
    f"WITH {_RESOLVED}, m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM c GROUP BY label)) SELECT sha, label, synthetic FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY synthetic, sha) AS k, count(*) OVER (PARTITION BY label) AS n FROM (SELECT sha, label, id % 3 = 0 AS synthetic FROM c)), m WHERE k <= CAST(floor(1.5 * least) AS BIGINT) OR n = least",
)
def _(t):
    rows = _resolved(t).select("sha", "label", (F.col("id") % 3 == 0).alias("synthetic"))
    return curation.balance(rows, 1.5)


_NORM = "trim(regexp_replace(left(d.text, 200), '\\s+', ' ', 'g'))"


@query(
    "divergence_regression",
    f"""WITH x AS (SELECT {_NORM} AS text FROM audit a JOIN documents d USING (doc_id) WHERE l2_label <> shadow_label AND NOT regexp_matches(left(d.text, 200), '<system-reminder|data:image/|base64,')),
    h AS (SELECT left(text, 16) AS head, arg_min(toxic, doc_id) AS want FROM (SELECT doc_id, toxic, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents JOIN labels USING (doc_id)) WHERE length(text) >= 16 GROUP BY 1)
    SELECT CASE WHEN want IS NOT NULL THEN sha1(text) END AS sha, want, count(*) AS dup FROM x LEFT JOIN h ON left(text, 16) = head WHERE length(text) >= 10 GROUP BY 1, 2""",
    ("audit",),
)
def _(t):
    texts = t("documents").select("doc_id", "text")
    rows = t("audit").join(texts, "doc_id").select(F.left("text", F.lit(200)).alias("text"), F.col("l2_label").alias("label"), F.col("shadow_label").alias("other"))
    candidates = texts.join(t("labels"), "doc_id").select(F.col("doc_id").alias("id"), scope.one_space(F.col("text")).alias("text"), F.col("toxic").alias("want"))
    return curation.divergences(rows, candidates)


@query("theta_overlap", "SELECT doc_id AS id, item_id AS held_id FROM documents d, benchmark b WHERE length(d.text) >= 8 AND length(b.text) >= 8 AND (strpos(d.text, b.text) > 0 OR strpos(b.text, d.text) > 0)")
def _(t):
    return curation.overlaps(t("documents").withColumnRenamed("doc_id", "id"), t("benchmark").withColumnRenamed("item_id", "id"))


@query("theta_prefix", "SELECT d.doc_id AS id, c.candidate FROM documents d LEFT JOIN (SELECT left(text, 16) AS head, min(item_id) AS candidate FROM benchmark WHERE length(text) >= 16 GROUP BY 1) c ON left(d.text, 16) = head")
def _(t):
    return curation.by_prefix(t("documents").withColumnRenamed("doc_id", "id"), t("benchmark").withColumnRenamed("item_id", "id"))


@query("anti_already_labeled", f"SELECT doc_id FROM documents WHERE {_SHA} NOT IN (SELECT {_SHA} FROM documents JOIN labels USING (doc_id))")
def _(t):
    return curation.hashed(t("documents")).join(_labelled(t).select("sha"), "sha", "left_anti").select("doc_id")


@query("dataset_concat", "SELECT 'doc' AS part, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark UNION ALL SELECT 'turn', conv_id, length(text) FROM conversations")
def _(t):
    part = lambda name, table, key: t(table).select(F.lit(name).alias("part"), F.col(key).alias("id"), F.length("text").cast("long").alias("size"))
    return part("doc", "documents", "doc_id").unionByName(part("item", "benchmark", "item_id")).unionByName(part("turn", "conversations", "conv_id"))


@query("report_diff", f"WITH {_SCORED}, a AS (SELECT id FROM e WHERE want <> got), b AS (SELECT id FROM e WHERE want <> (CASE WHEN p >= 0.7 THEN 1 ELSE 0 END)) SELECT 'new' AS change, id FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'fixed', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'still', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b)")
def _(t):
    rows = _scored(t)
    old, new = rows.where("want <> got").select("id"), rows.where("want <> CASE WHEN p >= 0.7 THEN 1 ELSE 0 END").select("id")
    tag = lambda name, df: df.select(F.lit(name).alias("change"), "id")
    return tag("new", new.subtract(old)).union(tag("fixed", old.subtract(new))).union(tag("still", old.intersect(new)))


@query("add_hard", f"WITH {_ROWS} SELECT sha, min(id) AS id FROM r WHERE length(text) >= 10 AND label IN (0, 1) AND sha NOT IN (SELECT sha FROM r WHERE id % 2 = 0) GROUP BY 1 ORDER BY 2 LIMIT 200")
def _(t):
    rows = _labelled(t)
    fresh = rows.where((F.length("text") >= 10) & F.col("label").isin(0, 1)).join(rows.where("id % 2 = 0").select("sha"), "sha", "left_anti")
    return fresh.groupBy("sha").agg(F.min("id").alias("id")).orderBy("id").limit(200)


@query("wrong_cases", f"WITH {_SCORED} SELECT min(e.id) AS id, {_SHA} AS sha FROM e JOIN documents d ON e.id = d.doc_id WHERE want <> got AND length(text) >= 10 GROUP BY 2")
def _(t):
    wrong = _scored(t).where("want <> got").select("id").join(_labelled(t).select("id", "sha", "text"), "id")
    return wrong.where(F.length("text") >= 10).groupBy("sha").agg(F.min("id").alias("id"))


@query(
    "labeled_regression",
    f"WITH x AS (SELECT a.id, a.ts, l2_label AS predicted, {_SHA} AS sha, toxic AS label FROM audit a JOIN documents USING (doc_id) JOIN labels USING (doc_id)) SELECT sha, count(*) AS dup, max(label) AS want, arg_max(predicted, struct_pack(t := ts, i := id)) FILTER (predicted IS NOT NULL) AS got FROM x WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY 1",
    ("audit",),
)
def _(t):
    texts = curation.hashed(t("documents")).select("doc_id", "sha")
    rows = t("audit").where("l2_label IS NOT NULL").join(texts, "doc_id").select("req_id", "doc_id", "id", "ts", "sha", F.col("l2_label").alias("predicted"))
    labels = rows.join(t("labels"), "doc_id").select("req_id", F.col("toxic").alias("label"))
    return curation.regressions(labels, rows.drop("doc_id"))


@query("assemble_report", f"WITH {_SCORED} SELECT lang AS category, count(*) AS total, {_N('(p >= 0.7) = (want = 1)')} AS correct FROM e GROUP BY 1")
def _(t):
    return _scored(t).groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("total"), F.count_if((F.col("p") >= 0.7) == (F.col("want") == 1)).alias("correct"))


@query("auto_label_rules", f"WITH {_SCORED} SELECT CASE WHEN n_chars % 7 = 0 THEN '1' WHEN n_chars % 40 < 20 AND p <= 0.3 THEN '0' ELSE 'queue' END AS label, count(*) AS n FROM e GROUP BY 1")
def _(t):
    label = curation.auto_label((F.col("n_chars") % 7 == 0).cast("int"), F.col("n_chars") % 40, F.col("p"))
    return _scored(t).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "cascade_sticky",
    "WITH x AS (SELECT conv_id, turn, (length(text) % 17 = 0) OR (length(text) % 50 >= 20 AND CAST(length(text) % 100 AS DOUBLE) / 100 >= 0.9) AS own FROM conversations) SELECT conv_id, turn, own OR coalesce(bool_or(own) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM x",
)
def _(t):
    n = F.length("text")
    rows = t("conversations").select(F.col("conv_id").alias("session"), "turn", (n % 17 == 0).cast("int").alias("flag"), (n % 50).alias("risk"), ((n % 100).cast("double") / 100).alias("p"))
    return evaluation.sticky_cascade(rows, 0.9).select(F.col("session").alias("conv_id"), "turn", "hit")


@query("confusion_metrics", f"WITH {_SCORED}, c AS (SELECT {_CONF} FROM (SELECT want = 1 AS w, got = 1 AS g FROM e)) SELECT {_RATES} FROM c")
def _(t):
    return evaluation.confusion(_scored(t))


@query("accuracy_confusion", f"WITH {_SCORED}, c AS (SELECT lang, {_CONF} FROM (SELECT lang, want = 1 AS w, got = 1 AS g FROM e) GROUP BY 1) SELECT lang, {_RATES} FROM c")
def _(t):
    return evaluation.confusion(_scored(t), "lang")


@query("group_score", f"WITH {_SCORED} SELECT source, count(*) AS n, {_N('want = got')} AS ok, {_N('want = 1 AND got = 0')} AS miss, {_N('want = 0 AND got = 1')} AS false_alarm FROM e GROUP BY 1")
def _(t):
    return evaluation.group_score(_scored(t), "source")


@query("scenario_matrix", f"WITH {_SCORED} SELECT 'lang' AS \"by\", lang AS item, {_N('want = 1 AND got = 1')} AS caught, {_N('want = 0 AND got = 0')} AS clean FROM e GROUP BY 2 UNION ALL SELECT 'source', source, {_N('want = 1 AND got = 1')}, {_N('want = 0 AND got = 0')} FROM e GROUP BY 2")
def _(t):
    return evaluation.matrix(_scored(t), "lang", "source")


@query("threshold_sweep", f"WITH {_SCORED}, c AS (SELECT threshold, {_CONF} FROM (SELECT CAST(x AS DOUBLE) / 10 AS threshold, want = 1 AS w, p >= CAST(x AS DOUBLE) / 10 AS g FROM e, (SELECT unnest([5, 6, 7, 8, 9]) AS x)) GROUP BY 1) SELECT threshold, {_RATES} FROM c")
def _(t):
    return evaluation.sweep(_scored(t), [0.5, 0.6, 0.7, 0.8, 0.9])


@query(
    "brier_and_calibration",
    f"""WITH {_SCORED}, k AS (SELECT *, count(*) OVER (PARTITION BY want) AS n, row_number() OVER (PARTITION BY want ORDER BY p, id) - 1 AS k FROM e)
    SELECT want, count(*) AS n, round(avg(pow(p - want, 2)), 9) AS brier, max(p) FILTER (k = least(floor(n * 0.1), n - 1)) AS p10, max(p) FILTER (k = least(floor(n * 0.5), n - 1)) AS p50, max(p) FILTER (k = least(floor(n * 0.9), n - 1)) AS p90 FROM k GROUP BY 1""",
)
def _(t):
    return evaluation.calibration(_scored(t))


_VARIANTS = {"full": "got = 1", "no_model": "n_chars % 3 = 0", "no_rules": "p >= 0.7"}


@query(
    "ablation_delta",
    f"WITH {_SCORED}, c AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, {_CONF} FROM (SELECT want = 1 AS w, {g} AS g FROM e)" for v, g in _VARIANTS.items()) + "), m AS (SELECT variant, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM c) SELECT m.variant, m.recall, m.fpr, (m.recall - f.recall) * 100 AS d_recall, (m.fpr - f.fpr) * 100 AS d_fpr FROM m, (SELECT * FROM m WHERE variant = 'full') f",
)
def _(t):
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.expr(g).alias("g")) for v, g in _VARIANTS.items()))
    rows = _scored(t).select("want", F.explode(each).alias("x")).select("want", "x.variant", "x.g")
    return evaluation.deltas(evaluation.confusion(rows, "variant", got=F.col("g")))


@query("variant_ab", "SELECT CASE WHEN l2_degraded THEN 'degraded' WHEN l2_label = shadow_label THEN concat('agree:', l2_label) ELSE concat(l2_label, '>', shadow_label) END AS case_, count(*) AS n FROM audit WHERE l2_label IS NOT NULL AND shadow_label IS NOT NULL GROUP BY 1", ("audit",))
def _(t):
    case = F.when(F.col("l2_degraded"), "degraded").when(F.col("l2_label") == F.col("shadow_label"), F.concat(F.lit("agree:"), "l2_label")).otherwise(F.concat("l2_label", F.lit(">"), "shadow_label"))
    return t("audit").where("l2_label IS NOT NULL AND shadow_label IS NOT NULL").groupBy(case.alias("case_")).agg(F.count("*").alias("n"))


@query("leaderboard", f"WITH {_SCORED}, c AS (SELECT lang AS candidate, {_CONF} FROM (SELECT lang, want = 1 AS w, got = 1 AS g FROM e) GROUP BY 1) SELECT candidate, recall, rank() OVER (ORDER BY recall DESC NULLS LAST, candidate) AS place FROM (SELECT candidate, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c)")
def _(t):
    from pyspark.sql import Window

    rows = evaluation.confusion(_scored(t).withColumnRenamed("lang", "candidate"), "candidate").select("candidate", "recall")
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("recall"), "candidate")).cast("long"))  # one row for each candidate


@query("relabel_metrics", f"WITH {_SCORED}, c AS (SELECT labels, {_CONF} FROM (SELECT 'original' AS labels, want = 1 AS w, got = 1 AS g FROM e UNION ALL SELECT 'strict', want = 1 AND id % 8 <> 0, got = 1 FROM e) GROUP BY 1) SELECT labels, {_RATES} FROM c")
def _(t):
    rows = _scored(t)
    both = F.array(F.struct(F.lit("original").alias("labels"), (F.col("want") == 1).alias("w")), F.struct(F.lit("strict").alias("labels"), ((F.col("want") == 1) & (F.col("id") % 8 != 0)).alias("w")))
    return evaluation.confusion(rows.select("got", F.explode(both).alias("x")).select("got", "x.labels", "x.w"), "labels", want=F.col("w"))


@query("modality_summary", f"WITH {_SCORED} SELECT coalesce(lang, 'total') AS kind, count(*) AS n, {_N('want = got')} AS correct, CAST(median(n_chars) AS DOUBLE) AS median_size FROM e GROUP BY ROLLUP (lang)")
def _(t):
    rows = _scored(t).rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("want") == F.col("got")).alias("correct"), F.median("n_chars").alias("median_size"))
    return rows.select(F.coalesce("lang", F.lit("total")).alias("kind"), "n", "correct", "median_size")


@query("last_user_text", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def _(t):
    users = t("conversations").where((F.col("role") == "user") & (scope.norm("text") != ""))
    return users.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("prev_user_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE k IN (2, 3) GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    users = t("conversations").where((F.col("role") == "user") & (scope.norm("text") != ""))
    before = users.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3 AND k >= 2")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return before.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("text"))


@query("session_fingerprint", "SELECT conv_id, sha256(arg_min(text, turn)) AS fingerprint FROM conversations WHERE role = 'user' GROUP BY 1")
def _(t):
    return t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.sha2(F.min_by("text", "turn"), 256).alias("fingerprint"))
