"""The registered queries: each takes (spark, sf_dir) and runs over the whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import missing, text
from mailsift.operators import assemble, clusters, dedup, embed, folds, metrics, models, scale, tfidf
from mailsift.plans import clean, evaluate, grid
from mailsift.plans import cluster_report as embedding_plan
from mailsift.session import shared_folder, shuffles_removed, write_and_read
from mailsift.sources import embeddings as embedding_files
from mailsift.sources import emails as email_files

from . import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    """Register under the function's name, with plain types: bigint for whole numbers, doubles to 6 places."""

    def plain(spark: SparkSession, sf: str) -> DataFrame:
        df = run(spark, sf)
        out = []
        for name, kind in df.dtypes:
            if kind in ("int", "smallint", "tinyint", "boolean"):
                out.append(F.col(name).cast("bigint").alias(name))
            elif kind in ("double", "float"):
                out.append(F.round(F.col(name).cast("double"), 6).alias(name))
            else:
                out.append(F.col(name))
        return df.select(*out)

    QUERIES[run.__name__] = plain
    return run


# cleaning


@query
def dedup_keep_first(spark, sf):
    kept = dedup.dedup_keep_first(tables.emails(spark, sf), ["subject", "body"])
    return kept.select("email_id", F.length("subject").alias("subject_chars"), F.md5("body").alias("body_md5"), "label")


@query
def dedup_count(spark, sf):
    return dedup.duplicate_count(tables.emails(spark, sf), ["subject", "body"])


@query
def sender_parts(spark, sf):
    parts = clean.with_sender_parts(tables.emails(spark, sf))
    return parts.select("email_id", "sender_clean", "sender_email", "sender_domain", "sender_tld")


@query
def text_stats(spark, sf):
    stats = clean.with_text_stats(tables.emails(spark, sf))
    return stats.select(
        "email_id",
        "subject_capitalized_percentage",
        "body_capitalized_percentage",
        "body_word_count",
        "subject_word_count",
        "total_char_count",
        "symbol_count",
        "symbol_ratio",
    )


@query
def repeat_symbols(spark, sf):
    return clean.with_text_stats(tables.emails(spark, sf)).select("email_id", "repeating_symbol_count")


@query
def date_features(spark, sf):
    dated = clean.with_date_features(tables.emails(spark, sf))
    return dated.select(
        "email_id", F.unix_seconds("datetime").alias("unix_seconds"), "day_of_week", "is_weekend", "is_night"
    )


@query
def clean_text(spark, sf):
    return clean.with_clean_text(tables.emails(spark, sf)).select(
        "email_id", "subject_clean", "body_clean", "email_text_clean"
    )


@query
def clean_html_text(spark, sf):
    """The cleaning chain on whole web pages, which have HTML entities."""
    pages = tables.table(spark, sf, "pages").select("page_id", "html")
    return text.clean_text(pages, {"html": "html_clean"}).select("page_id", "html_clean")


@query
def clean_broken_text(spark, sf):
    """The cleaning chain on documents with quotes and letters broken by a wrong decoding, and with ligatures (NFKC)."""
    broken = F.col("text")
    for char, instead in (("'", "â€™"), ("é", "Ã©"), ("ç", "Ã§"), ("fi", "\ufb01")):
        broken = F.replace(broken, F.lit(char), F.lit(instead))
    docs = tables.table(spark, sf, "documents").select("doc_id", broken.alias("text"))
    return text.clean_text(docs, {"text": "text_clean"}).select("doc_id", "text_clean")


@query
def known_domain_flags(spark, sf):
    parts = clean.with_sender_parts(tables.emails(spark, sf))
    flagged = clean.with_known_domains(parts, *_lists(spark, sf))
    return flagged.select("email_id", "is_known_domain", "is_known_fortune_domain")


def _lists(spark, sf):
    return tables.domain_list(spark, sf, ".com"), tables.domain_list(spark, sf, ".org")


def _clean(spark, sf, **options):
    return clean.clean_emails(tables.emails(spark, sf), *_lists(spark, sf), **options)


@query
def clean_emails(spark, sf):
    return _clean(spark, sf, sentinel=True)


@query
def domain_flag_summary(spark, sf):
    """Emails and mean symbol ratio by domain flag and label."""
    df = clean.with_text_stats(dedup.dedup_keep_first(tables.emails(spark, sf), ["subject", "body"]))
    df = clean.with_known_domains(clean.with_sender_parts(df), *_lists(spark, sf))
    return df.groupBy("is_known_domain", "label").agg(
        F.count(F.lit(1)).alias("n_emails"), F.avg("symbol_ratio").alias("avg_symbol_ratio")
    )


@query
def sentinel_roundtrip(spark, sf):
    df = tables.emails(spark, sf).select(
        "email_id",
        missing.to_sentinel(F.col("sender")).alias("sender_out"),
        missing.to_sentinel(F.md5(missing.from_sentinel(F.nullif("body", F.lit(""))))).alias("body_out"),
    )
    return df.withColumns(
        {"sender_back": missing.blank_sentinel(F.col("sender_out")), "body_back": missing.from_sentinel(F.col("body_out"))}
    )


@query
def feature_coerce(spark, sf):
    e = tables.table(spark, sf, "events").withColumn("piece", F.get_json_object("props", "$.k"))
    return e.select(
        "event_id",
        missing.number_or_zero(F.col("props")).alias("from_json"),
        missing.number_or_zero(F.col("piece")).alias("from_piece"),
        missing.number_or_zero(F.col("value")).alias("from_value"),
        missing.number_or_zero(F.col("event_type")).alias("from_type"),
    )


@query
def optional_columns(spark, sf):
    """Drop a column that is there and one that is not; add a constant for one that is missing."""
    df = missing.with_default(tables.emails(spark, sf).withColumn("receiver", F.col("sender")), "urls")
    return df.drop("receiver", "reply_to", "subject", "body").select("email_id", "sender", "date", "urls", "label")


@query
def csv_roundtrip(spark, sf):
    """The cleaned table through CSV and back, as text, then typed again."""
    path = os.path.join(shared_folder(spark), f"clean-csv-{uuid.uuid4().hex}")
    email_files.write_clean(_clean(spark, sf), path, "csv")
    back = email_files.read_emails(spark, path, "csv")
    return back.select(
        "email_id",
        "email_text_clean",
        "sender_tld",
        missing.strict_label(F.nullif("label", F.lit(""))).alias("label"),
        *[missing.number_or_zero(F.col(c)).alias(c) for c in assemble.TABULAR],
    )


@query
def domain_list_roundtrip(spark, sf):
    path = os.path.join(shared_folder(spark), f"domains-{uuid.uuid4().hex}")
    hosts = tables.table(spark, sf, "pages").select(F.regexp_extract("url", tables.HOST, 1).alias("Root Domain"))
    hosts.write.option("header", True).csv(path)
    return email_files.read_domain_list(spark, path, "Root Domain")


# text features


def _tokens(spark, sf):
    return tfidf.with_tokens(_clean(spark, sf).select("email_id", "label", "email_text_clean"), "email_text_clean")


def _stored_tokens(spark, sf):
    return write_and_read(_tokens(spark, sf).drop("email_text_clean"), "tokens")


@query
def token_counts(spark, sf):
    return _tokens(spark, sf).select(
        "email_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


@query
def tfidf_terms(spark, sf):
    return tfidf.top_terms(_stored_tokens(spark, sf), "tokens", (1, 3), 1000)


@query
def tfidf_idf(spark, sf):
    return tfidf.fit_tfidf(_stored_tokens(spark, sf)).table(spark)


@query
def tfidf_weights(spark, sf):
    df = _stored_tokens(spark, sf)
    return tfidf.fit_tfidf(df).long_weights(df)


@query
def tfidf_holdout_weights(spark, sf):
    """Vocabulary and idf from the training rows, applied to the test rows."""
    split = folds.stratified_split(_stored_tokens(spark, sf).where("label IS NOT NULL"))
    return tfidf.fit_tfidf(split.where("NOT is_test")).long_weights(split.where("is_test"))


@query
def ngram_ranges(spark, sf):
    """Occurrences and distinct n-grams for each range of the search."""
    with shuffles_removed(spark):
        df = _stored_tokens(spark, sf)
    return tfidf.range_totals(df, "tokens", grid.RANGES)


@query
def standard_scale(spark, sf):
    df = _clean(spark, sf).select("email_id", *assemble.TABULAR)
    df = write_and_read(df, "numbers")  # read to fit and again to scale
    return scale.fit_scaling(df, assemble.TABULAR).transform(df)


@query
def embed_text(spark, sf):
    """The built-in encoder on whole texts, one row per vector entry."""
    df = embed.embed_text(_clean(spark, sf).select("email_id", "email_text_clean"), "email_text_clean")
    return df.select("email_id", F.posexplode("embedding").alias("dim", "value"))


@query
def embedding_roundtrip(spark, sf):
    path = os.path.join(shared_folder(spark), f"embeddings-{uuid.uuid4().hex}")
    embedding_files.write_embeddings(tables.labelled_embeddings(spark, sf), path, row_id="vec_id")
    back = embedding_files.read_embeddings(spark, path)
    return back.select("vec_id", "label", F.posexplode("embedding").alias("dim", "value"))


@query
def embedding_shape(spark, sf):
    return metrics.embedding_shape(tables.table(spark, sf, "embeddings"))


@query
def fused_features(spark, sf):
    """Width, sum and squared length of the fused vector of each labelled email."""
    base = evaluate.base_features(_clean(spark, sf))
    ready, _ = evaluate.prepared(base, base, ["fused"])
    values = vector_to_array("features")
    return (
        assemble.fuse(ready, "fused")
        .select("email_id", values.alias("v"))
        .select(
            "email_id",
            F.size("v").alias("n_features"),
            F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"),
            F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("squared_length"),
        )
    )


# splits


def _labelled_ids(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("email_id"), F.col("toxic").alias("label"))
    return d.join(lab, "email_id").where("label IS NOT NULL")


@query
def stratified_split(spark, sf):
    return folds.stratified_split(_labelled_ids(spark, sf))


@query
def stratified_folds(spark, sf):
    return folds.stratified_folds(_labelled_ids(spark, sf))


@query
def plain_folds(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("email_id"), F.col("toxic").alias("label"))
    return folds.plain_folds(d.join(lab, "email_id", "left"))


@query
def size_summary(spark, sf):
    return metrics.size_summary(folds.stratified_split(_labelled_ids(spark, sf)))


# metrics


@query
def score_threshold(spark, sf):
    return tables.scored(spark, sf).select("email_id", "prob", models.predicted().alias("pred"))


@query
def align_rows(spark, sf):
    """Features, label and score of the same email."""
    feats = clean.with_text_stats(tables.emails(spark, sf).drop("label")).select("email_id", "symbol_count")
    return feats.join(tables.scored(spark, sf), "email_id").select("email_id", "label", "symbol_count", "prob")


@query
def confusion(spark, sf):
    return metrics.confusion(tables.scored(spark, sf))


@query
def binary_metrics(spark, sf):
    return metrics.binary_metrics(tables.scored(spark, sf))


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(tables.scored(spark, sf))


@query
def triage(spark, sf):
    return metrics.triage(tables.scored(spark, sf))


@query
def triage_crosstab(spark, sf):
    return metrics.triage_crosstab(tables.scored(spark, sf))


@query
def class_distribution(spark, sf):
    return metrics.class_distribution(tables.scored(spark, sf))


@query
def classification_report(spark, sf):
    df = tables.scored(spark, sf).withColumn("pred", models.predicted())
    return metrics.classification_report(df, "label", "pred")


@query
def class_weights(spark, sf):
    return models.class_weights(tables.scored(spark, sf))


@query
def method_compare(spark, sf):
    """One metric row per scoring method and evaluation set, on given scores."""
    split = folds.stratified_split(tables.scored(spark, sf))
    methods = {
        "chars": F.col("prob"),
        "inverse": F.lit(1.0) - F.col("prob"),
        "id_hash": ((F.col("email_id") * 7919) % 1009) / F.lit(1009.0),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("feature_set"), p.alias("prob")) for m, p in methods.items()])
    set_name = F.when(F.col("is_test"), "held_out").otherwise("cross_validation").alias("eval_set")
    return metrics.evaluation(
        split.select("email_id", "label", set_name, F.inline(cells)), ["feature_set", "eval_set"]
    )


# clusters


@query
def cluster_majority(spark, sf):
    return clusters.cluster_majority(tables.clustered(spark, sf))


@query
def cluster_report(spark, sf):
    """Classification report of clusters mapped to their majority label."""
    return metrics.classification_report(clusters.with_majority(tables.clustered(spark, sf)), "label", "mapped_label")


@query
def silhouette(spark, sf):
    return clusters.silhouette(tables.clustered(spark, sf))


@query
def ari(spark, sf):
    return clusters.adjusted_rand(tables.clustered(spark, sf))


@query
def nmi(spark, sf):
    return clusters.normalized_mutual_info(tables.clustered(spark, sf))


# models: what a learner gives differs between engines, so those below whose rows SQL can know return facts that hold for
# any right result; the tests look at the results themselves


@query
def oof_logistic(spark, sf):
    """Every row once, in its fold, with a probability."""
    scores = embedding_plan.cross_validated_logistic(tables.labelled_embeddings(spark, sf))
    return scores.select("vec_id", "label", "fold", F.coalesce(F.col("prob").between(0, 1), F.lit(False)).alias("scored"))


@query
def oof_gbt(spark, sf):
    """Every row once for each feature set, in its fold, with a probability."""
    scores = write_and_read(evaluate.out_of_fold(evaluate.base_features(_clean(spark, sf))), "scores")
    scored = F.coalesce(F.col("prob").between(0, 1), F.lit(False)).alias("scored")
    return scores.select("email_id", "label", "fold", "feature_set", scored)


@query
def holdout_eval(spark, sf):
    base = evaluate.base_features(_clean(spark, sf))
    scores = evaluate.held_out(base)
    # stored, as the measures read the scores several times and every reading would run the models
    return metrics.evaluation(write_and_read(scores, "scores"), ["feature_set"])


@query
def train_test_evaluation(spark, sf):
    return evaluate.train_test_evaluation(evaluate.base_features(_clean(spark, sf)))


@query
def grid_search(spark, sf):
    emails = write_and_read(_clean(spark, sf).select("email_id", "label", "body_clean"), "grid-texts")
    labelled = folds.stratified_split(emails.where("label IS NOT NULL"))
    return grid.search(grid.fold_accuracy(labelled.where("NOT is_test")))


@query
def kmeans_best(spark, sf):
    """Whether each row is at its nearest centre, and whether that centre is the mean of its rows."""
    points = clusters.with_vector(tables.labelled_embeddings(spark, sf))
    model = clusters.kmeans_best(points)
    rows = model.transform(points).withColumn("x", vector_to_array("features"))
    gaps = []
    for centre in model.clusterCenters():
        values = F.array(*map(F.lit, centre.tolist()))
        gaps.append(F.aggregate(F.zip_with("x", values, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, v: s + v))
    own = F.element_at(F.array(*gaps), F.col("prediction") + 1)
    at_nearest = (own <= F.array_min(F.array(*gaps)) + 1e-9).alias("at_nearest")
    means = _cluster_means(rows, "features")
    settled = [k for k, c in enumerate(model.clusterCenters()) if k in means and np.allclose(means[k], c, atol=1e-3)]
    return rows.select("vec_id", "label", at_nearest, F.col("prediction").isin(settled).alias("at_mean"))


def _cluster_means(rows: DataFrame, features: str) -> dict:
    """The mean vector of each cluster: as many rows as the model has centres."""
    means = rows.groupBy("prediction").agg(Summarizer.mean(F.col(features)).alias("mean")).collect()
    return {r["prediction"]: r["mean"].toArray() for r in means}


@query
def pca_2d(spark, sf):
    """Rows, and what the scores of principal components have: mean 0, no covariance, falling variance."""
    points = clusters.with_vector(tables.labelled_embeddings(spark, sf))
    return clusters.fit_pca(points).transform(points).agg(
        F.count("*").alias("n_rows"),
        F.abs(F.round(F.avg("pc1"), 6)).alias("mean_pc1"),
        F.abs(F.round(F.avg("pc2"), 6)).alias("mean_pc2"),
        F.abs(F.round(F.covar_samp("pc1", "pc2"), 6)).alias("covariance"),
        (F.var_samp("pc1") >= F.var_samp("pc2")).alias("falling"),
    )


@query
def pca_variance(spark, sf):
    """The total variance, and whether each component's share of it is the variance of its scores."""
    points = clusters.with_vector(tables.labelled_embeddings(spark, sf))
    fitted = clusters.fit_pca(points)
    scores = fitted.transform(points).agg(
        F.var_samp("pc1").alias("v1"),
        F.var_samp("pc2").alias("v2"),
        Summarizer.variance(F.col("features")).alias("each"),
    )
    total = F.aggregate(vector_to_array("each"), F.lit(0.0), lambda s, v: s + v)
    scores = scores.select("v1", "v2", total.alias("total_variance"))
    shares = fitted.explained_variance(spark).join(F.broadcast(scores))
    own = F.when(F.col("component") == 1, F.col("v1")).otherwise(F.col("v2"))
    agrees = F.abs(F.col("variance_share") * F.col("total_variance") - own) < 1e-6 * F.col("total_variance")
    return shares.select("component", "total_variance", agrees.alias("agrees"))


@query
def pca_centroids(spark, sf):
    """Whether each projected centre is the mean of its rows' projections."""
    points = clusters.with_vector(tables.labelled_embeddings(spark, sf))
    model, fitted = clusters.kmeans_best(points), clusters.fit_pca(points)
    centres = fitted.transform(clusters.centroids(model, spark)).select("cluster", "pc1", "pc2")
    rows = fitted.transform(model.transform(points)).groupBy(F.col("prediction").alias("cluster"))
    means = rows.agg(F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"))
    near = (F.abs(F.col("pc1") - F.col("m1")) < 1e-3) & (F.abs(F.col("pc2") - F.col("m2")) < 1e-3)
    return centres.join(means, "cluster", "left").select("cluster", F.coalesce(near, F.lit(False)).alias("at_mean"))
