"""Whole jobs on small inputs: cleaning from a CSV file, evaluation, search, and queries next to their SQL."""

import inspect
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from mailsift.functions.missing import strict_label
from mailsift.operators import clusters, folds, models, ngram_logistic, tfidf
from mailsift.operators.boost import Booster
from mailsift.plans import clean, cluster_report, evaluate, grid
from mailsift.session import spread, write_and_read
from mailsift.sources import embeddings as embedding_files
from mailsift.sources import emails as email_files

RAW = '''sender,receiver,date,subject,body,label,urls
Bob <bob@example.com>,me,"Tue, 05 Aug 2008 16:31:02 -0700","WIN !!!!!",  "Say ""hi"" &amp; go
now$$$",1,1
ann@fortune.org,me,"Sat, 06 Jan 2024 04:59:59 +0000",Notes,"plain, text",0,0
Bob <bob@example.com>,you,bad,Notes,"plain, text",1,0
,me,,,,0,0
'''


@pytest.fixture
def cleaned(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(RAW.replace(",  \"", ",\""), encoding="utf-8")
    (tmp_path / "top.csv").write_text("Rank,Root Domain\n1,example.com\n2,example.com\n3,\n", encoding="utf-8")
    (tmp_path / "fortune.csv").write_text("Company,Domain\nF,fortune.org\n", encoding="utf-8")
    emails = email_files.read_emails(spark, str(tmp_path / "raw.csv"))
    top = email_files.read_domain_list(spark, str(tmp_path / "top.csv"), "Root Domain")
    fortune = email_files.read_domain_list(spark, str(tmp_path / "fortune.csv"), "Domain")
    assert top.count() == 1
    return clean.clean_emails(emails, top, fortune, sentinel=True)


def test_clean_from_csv(cleaned):
    rows = cleaned.orderBy("email_id").collect()
    assert cleaned.columns == ["email_id", *clean.EXPORT_COLUMNS]
    assert len(rows) == 3
    first, second, third = rows
    assert first["subject_clean"] == "win [SYMBOL_NOISE]"
    assert first["body_clean"] == 'say "hi" & go now$$$'
    assert first["email_text_clean"] == 'win [SYMBOL_NOISE] say "hi" & go now$$$'
    assert (first["is_known_domain"], first["is_known_fortune_domain"], first["sender_tld"]) == (1, 0, "com")
    assert first["total_char_count"] == len('WIN !!!!! Say "hi" &amp; go\nnow$$$')
    assert (first["symbol_count"], first["repeating_symbol_count"]) == (12, 2)
    assert (first["subject_word_count"], first["body_word_count"]) == (2, 5)
    assert (second["is_weekend"], second["is_night"], second["is_known_fortune_domain"]) == (1, 1, 1)
    assert second["label"] == 0 and second["urls"] == "0"
    assert third["email_text_clean"] == third["sender_tld"] == third["subject_clean"] == "NaN"
    assert third["symbol_ratio"] == 0 and third["total_char_count"] == 0


def test_csv_written_and_read_back(spark, cleaned, tmp_path):
    path = str(tmp_path / "out")
    email_files.write_clean(cleaned, path, "csv")
    back = email_files.read_emails(spark, path)
    assert back.columns == cleaned.columns
    text = {r["email_id"]: r["email_text_clean"] for r in back.collect()}
    assert text == {r["email_id"]: r["email_text_clean"] for r in cleaned.collect()}
    assert sorted(r[0] for r in back.select(strict_label(F.col("label"))).collect()) == [0, 0, 1]
    email_files.write_clean(cleaned, str(tmp_path / "parquet"))
    assert email_files.read_emails(spark, str(tmp_path / "parquet"), "parquet").count() == 3
    with pytest.raises(ValueError):
        email_files.read_emails(spark, path, "xml")


def test_embedding_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0])], "email_id long, label int, embedding array<double>")
    embedding_files.write_embeddings(df, str(tmp_path / "e"))
    assert embedding_files.read_embeddings(spark, str(tmp_path / "e")).first()["embedding"] == [1.0, 2.0]
    with pytest.raises(Exception):
        embedding_files.read_embeddings(spark, str(tmp_path / "none"))


@pytest.fixture(scope="module")
def base(spark):
    """Separable mail: spam speaks of prizes."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        spam = i % 3 == 0
        words = rng.choices(["prize", "winner", "cash"] if spam else ["meeting", "report", "monday"], k=6)
        rows.append((i, int(spam), " ".join(words), " ".join(words)))
    df = spark.createDataFrame(rows, "email_id long, label int, email_text_clean string, body_clean string")
    return df.withColumns({c: (F.col("email_id") % 5).cast("double") for c in evaluate.assemble.TABULAR}).cache()


def test_train_test_evaluation(base):
    ready = evaluate.base_features(base)
    metrics = evaluate.train_test_evaluation(
        ready, ["pure_tfidf", "fused"], k=3, max_features=20, make_classifier=lambda rows: models.boosted_trees(2, depth=2)
    ).collect()
    assert {(r["feature_set"], r["eval_set"]) for r in metrics} == {
        (f, e) for f in ("pure_tfidf", "fused") for e in ("cross_validation", "held_out")
    }
    for r in metrics:
        n = r["tn"] + r["fp"] + r["fn"] + r["tp"]
        assert n == (48 if r["eval_set"] == "cross_validation" else 12)
        assert r["inbox"] + r["quarantine"] + r["spam"] == n
        assert r["roc_auc"] > 0.9


def test_out_of_fold_scores_each_row_once(base):
    scores = evaluate.out_of_fold(
        evaluate.base_features(base), ["pure_bert"], k=3, make_classifier=lambda rows: models.logistic(rows)
    ).collect()
    assert sorted(r["email_id"] for r in scores) == list(range(60))
    assert all(0 <= r["prob"] <= 1 for r in scores)


def test_grid_search(base):
    found = grid.fold_accuracy(base, ranges=[(1, 2), (2, 3)], k=3).collect()
    assert len(found) == 6 and sum(r["n"] for r in found) == 120
    best = grid.search(base.sparkSession.createDataFrame(found)).collect()
    assert sum(r["is_best"] for r in best) == 1
    top = next(r for r in best if r["is_best"])
    assert top["mean_accuracy"] == max(r["mean_accuracy"] for r in best) > 0.9


@pytest.mark.parametrize("scope", ["global", "fold"])
def test_cross_validated_logistic(spark, scope):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.gauss(i % 2, 0.3), rng.gauss(0, 1), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    scores = cluster_report.cross_validated_logistic(df, k=4, scale_scope=scope).collect()
    assert sorted(r["vec_id"] for r in scores) == list(range(40))
    assert sum((r["prob"] >= 0.5) == r["label"] for r in scores) > 34
    with pytest.raises(ValueError):
        cluster_report.cross_validated_logistic(df, scale_scope="none")


def test_clustered_rows(spark):
    rng = random.Random(7)
    rows = [(i, i % 2, [rng.gauss(5 * (i % 2), 0.3), rng.gauss(0, 1)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out, model, projection = cluster_report.clustered(df, restarts=2)
    assert out.where("mapped_label <> label").count() == 0
    assert clusters.adjusted_rand(out).first()[0] == 1
    assert len(model.clusterCenters()) == 2 and len(projection.explained) == 2


def test_spread(spark):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


SMALL = ["dedup_keep_first", "date_features", "known_domain_flags", "stratified_folds", "roc_auc", "method_compare", "nmi"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_next_to_their_sql(spark, name):
    import os

    import duckdb

    from checks.compare import TABLES, rows_of
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert rows_of((df.columns, [tuple(r) for r in df.collect()])) == rows_of((columns, result.fetchall()))


def test_every_sql_belongs_to_a_query():
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    assert set(ORACLE) <= set(QUERIES)


def test_files_in_name_order_and_columns_by_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("subject,body,sender,label\nhi,same,a1,1\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("subject,body,sender,label\nhi,same,b1,0\n" + "x,y,b2,0\n" * 500, encoding="utf-8")
    (tmp_path / "in" / "c.csv").write_text("label,sender,body,subject\n1,c1,z,s\n", encoding="utf-8")
    rows = email_files.read_emails(spark, str(tmp_path / "in")).orderBy("email_id").collect()
    assert [r["sender"] for r in rows[:2]] == ["a1", "b1"] and rows[-1]["sender"] == "c1" and rows[-1]["label"] == "1"
    assert len({r["email_id"] for r in rows}) == len(rows) == 503


def test_csv_keeps_outer_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, "  a b "), (2, "\tq")], "email_id long, urls string")
    email_files.write_clean(df, str(tmp_path / "out"), "csv")
    assert [r["urls"] for r in email_files.read_emails(spark, str(tmp_path / "out")).orderBy("email_id").collect()] == ["  a b ", "\tq"]


@pytest.mark.parametrize("name, plan", [("oof_gbt", "out_of_fold"), ("holdout_eval", "held_out"), ("train_test_evaluation", "train_test_evaluation")])
def test_registered_evaluations_have_the_full_settings(monkeypatch, name, plan):
    seen = []
    signature = inspect.signature(getattr(evaluate, plan))

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(evaluate, plan, record)
    monkeypatch.setattr(evaluate, "base_features", lambda clean: clean)
    monkeypatch.setattr(queries, "_clean", lambda *_: None)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](None, "")
    assert seen[0]["feature_sets"] == evaluate.assemble.FEATURE_SETS and seen[0]["max_features"] == 1000
    assert seen[0]["make_classifier"] is evaluate.default_classifier


ODD_FIELDS = ["a", "", '"q"', '"x, y"', '"l1\nl2"', '"\n"', '""', '"say ""hi"""', '"""\n"""', 'in "the" middle', 'a"b', '"é€😀\n\né"', " b ", '",\n"",\n"']


def _csv_text(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = [",".join([f"k{i}", *rng.choices(ODD_FIELDS, k=3)]) for i in range(rows)]
    lines[3:3] = ["", ""]
    return end.join(["id,x,y,z", *lines]).replace("\n", end) + (end if seed % 2 else "")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,end", [(0, "\n"), (1, "\n"), (2, "\r\n"), (3, "\r\n")])
def test_csv_cut_into_splits(spark, tmp_path, small_splits, seed, end):
    file = tmp_path / "big.csv"
    file.write_bytes(_csv_text(seed, 600, end).encode())
    rows = email_files.read_emails(spark, str(file)).orderBy("email_id").collect()
    whole = email_files._all_text_csv(spark, str(file), ["id", "x", "y", "z"]).collect()
    assert [r["email_id"] for r in rows] == list(range(600))
    assert [tuple(r)[:4] for r in rows] == [tuple(r) for r in whole]
    blocks = spark.read.text(str(file)).select("_metadata.file_block_start").distinct().count()
    assert blocks > 10


def test_csv_record_over_many_splits(spark, tmp_path, small_splits):
    body = "line, with comma\n" * 500
    text = f'sender,body\na,"{body}"\nb,"""{body}"\nc,plain\nd,"never closed\n{body}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.csv").write_text(text, encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text('\ufeffbody,sender\n"x\ny",e\n', encoding="utf-8")
    (tmp_path / "in" / "c.csv").write_bytes(b"sender,body\rf,mac\r")
    (tmp_path / "in" / "d.csv").write_text("", encoding="utf-8")
    (tmp_path / "in" / "e.csv").write_text("\n\n", encoding="utf-8")
    rows = email_files.read_emails(spark, str(tmp_path / "in")).orderBy("email_id").collect()
    assert [r["sender"] for r in rows] == ["a", "b", "c", "d", "e", "f"]
    assert rows[0]["body"] == body and rows[1]["body"] == '"' + body
    assert rows[3]["body"].startswith("never closed\nline") and rows[4]["body"] == "x\ny" and rows[5]["body"] == "mac"


def test_csv_quoted_header_and_empty_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"a\nb",c,C,\n1,2,3,4\n', encoding="utf-8")
    df = email_files.read_emails(spark, str(tmp_path / "one.csv"))
    assert df.columns == ["a\nb", "c1", "C2", "_c3", "email_id"]
    assert tuple(df.first()) == ("1", "2", "3", "4", 0)
    (tmp_path / "head.csv").write_text("a,b\n", encoding="utf-8")
    assert email_files.read_emails(spark, str(tmp_path / "head.csv")).collect() == []


def test_grid_search_by_rows_as_by_terms(spark):
    """The odds by row numbers are those of MLlib's model on the whole vocabulary, which used to be in the driver."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(40)}{'x' * rng.randrange(3)}" for _ in range(60)]
    rows = [(i, i % 2, " ".join(rng.choices(words[i % 2 * 15 : 45 + i % 2 * 15], k=rng.randrange(0, 30)))) for i in range(90)]
    rows += [(90 + i, 1, rows[1][2]) for i in range(4)] + [(95, 0, None), (96, 1, "of the")]
    df = spark.createDataFrame(rows, "email_id long, label int, body_clean string")
    tokens = tfidf.with_tokens(df, "body_clean").withColumn("place", F.monotonically_increasing_id())
    folded = folds.plain_folds(write_and_read(tokens, "t"), 3)
    numbered = ngram_logistic.numbered(folded)
    known = numbered.select("row", "email_id", "label", "fold").toArrow().sort_by("row")
    assert known["row"].to_pylist() == list(range(len(rows)))
    fold, label = known["fold"].to_numpy(), known["label"].to_numpy()
    in_train = fold[:, None] != np.arange(3)
    parts = [ngram_logistic.blocks(numbered, "tokens", n, 3, in_train.sum(axis=0).tolist(), block=50) for n in (1, 2)]
    odds = ngram_logistic.margins(ngram_logistic.products(parts, in_train), label, in_train)
    counted = tfidf.full_counter(folded, "tokens", (1, 2)).transform(folded).persist()
    train, test = counted.where("fold <> 1"), counted.where("fold = 1")
    weighting = tfidf.fit_weighting(train, drop_unseen=True)
    fit_on, test = (weighting.transform(x, out="features") for x in (train, test))
    model = models.logistic(weighting.rows).setTol(1e-12)
    wanted = {r["email_id"]: r["prob"] for r in models.fit_and_score(model, fit_on, test, ["email_id"]).collect()}
    ids = known["email_id"].to_numpy()
    ours = {int(i): 1 / (1 + np.exp(-x)) for i, x in zip(ids[fold == 1], odds[fold == 1, 1])}
    assert ours.keys() == wanted.keys()
    assert max(abs(ours[i] - wanted[i]) for i in ours) < 1e-5
    by_rows = grid._by_rows(folded, [(1, 2), (2, 3)], 3, 100)
    assert by_rows == grid._by_terms(folded.drop("place"), [(1, 2), (2, 3)], 3, 100, None)


def test_models_of_all_feature_sets_are_fitted_side_by_side(base):
    """They used to be fitted one after another, each in its one task."""
    barrier = threading.Barrier(3, timeout=60)

    def make(rows):
        barrier.wait()
        return Booster(rounds=2, depth=2)

    scores = evaluate.held_out(evaluate.base_features(base), make_classifier=make)
    assert scores.count() == 36


def test_logistic_steps_need_few_products():
    """Each step used to solve for two vectors, from zero accuracy to full; a product is a job over all postings."""
    rng = np.random.default_rng(8)
    x = rng.random((120, 60)) * (rng.random((120, 60)) < 0.2) + 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = (x[:, 0] + 0.2 * rng.normal(size=120) > 0.15).astype(int)
    in_train = (np.arange(120) % 3)[:, None] != np.arange(3)
    sent = []

    def times(v):
        sent.append(v.shape[2])
        return np.einsum("ij,jfm->ifm", x @ x.T, v)

    odds = ngram_logistic.margins(times, label, in_train)
    assert sum(sent) <= 20  # 50 before
    for f in range(3):
        a, w = np.column_stack([x, np.ones(120)]), np.zeros(61)
        known, y, penalty = a[in_train[:, f]], label[in_train[:, f]], np.append(np.ones(60), 0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-known @ w))
            w -= np.linalg.solve(known.T @ (known * (p * (1 - p))[:, None]) + np.diag(penalty), known.T @ (p - y) + penalty * w)
        assert np.abs(a @ w - odds[:, f]).max() < 1e-6
