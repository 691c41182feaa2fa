"""Registered queries (one per operator or operator group of the survey)
and their DuckDB oracle SQL.  Every query reads the driver's tables in
full, through the projections in ``fixtures``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskfold.operators import features as feat
from riskfold.operators import dataset as ds
from riskfold.operators import evaluate as ev
from riskfold.operators import explain as xp
from riskfold.operators import labels as lab
from riskfold.operators import score as sc
from riskfold.operators import train as tr
from riskfold.plans import fixtures as fx
from riskfold.plans import oracle as orc
from riskfold.schema import FEATURE_NAMES

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- F0-F28: features --------------------------------------------------------

@register("features_t1", orc.features_t1())
def features_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feat.extract_features(fx.source_files_from_part(spark, sf_dir))
    return f.select("repo", "path", *FEATURE_NAMES)


@register("features_constructs", orc.features_constructs())
def features_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that hold every construct the features count."""
    f = feat.extract_features(fx.construct_files_from_part(spark, sf_dir))
    return f.select("repo", "path", *FEATURE_NAMES)


@register("line_features_documents", orc.line_features_documents())
def line_features_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: line statistics of every document (full texts) through the
    parse-free line path; only line features are SQL-expressible here."""
    f = feat.line_features(fx.source_files_from_documents(spark, sf_dir))
    return f.select("repo", "path", "total_lines", "blank_lines")


@register("documents_parse_outcome")
def documents_parse_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 through the full extraction: the parse-failure path (syntax
    errors, parser failures isolated as error rows) over whole documents."""
    from pyspark.sql import functions as F

    f = feat.extract_features(fx.source_files_from_documents(spark, sf_dir))
    return f.select("repo", "path", "total_lines", "comment_lines", "syntax_error",
                    F.col("error").isNotNull().alias("failed"))


# --- S3, L1-L8: labelling -----------------------------------------------------

SMALL_FILE_CAP = 60   # binds at sf0.01 (80 files per repo)
SMALL_COMMIT_CAP = 5  # binds at sf0.01
SMALL_DEPTH = 20
SHALLOW_DEPTH = 100


@register("file_cap_per_repo", orc.file_cap(SMALL_FILE_CAP))
def file_cap_per_repo(spark, sf_dir):
    return lab.cap_files(fx.working_tree_from_part(spark, sf_dir), SMALL_FILE_CAP)


@register("bug_fix_commits", orc.bug_fix_commits())
def bug_fix_commits(spark, sf_dir):
    commits, _ = fx.history_from_orders(spark, sf_dir)
    return lab.bug_fix_commits(commits).select("repo", "commit_id", "message")


@register("newest_bug_fixes", orc.newest_bug_fixes(SMALL_COMMIT_CAP))
def newest_bug_fixes(spark, sf_dir):
    commits, _ = fx.history_from_orders(spark, sf_dir)
    return lab.newest_bug_fixes(commits, SMALL_COMMIT_CAP).select("repo", "commit_id")


@register("history_depth", orc.history_depth(SMALL_DEPTH))
def history_depth(spark, sf_dir):
    commits, _ = fx.history_from_orders(spark, sf_dir)
    return lab.history_depth(commits, SMALL_DEPTH).select("repo", "commit_id")


@register("changed_py_files", orc.changed_py_files())
def changed_py_files(spark, sf_dir):
    commits, files = fx.history_from_orders(spark, sf_dir)
    return lab.changed_python_files(commits, files)


@register("buggy_paths", orc.buggy_paths(None))
def buggy_paths(spark, sf_dir):
    commits, files = fx.history_from_orders(spark, sf_dir)
    return lab.buggy_paths(commits, files)


@register("last_modified", orc.last_modified())
def last_modified(spark, sf_dir):
    commits, files = fx.history_from_orders(spark, sf_dir)
    return lab.last_modified(commits, files)


def _labels(spark, sf_dir, max_files=None, cap=None, depth=None):
    commits, files = fx.history_from_orders(spark, sf_dir)
    tree = fx.working_tree_from_part(spark, sf_dir)
    return lab.label_files(tree, commits, files, fx.AS_OF, max_files=max_files, cap=cap, depth=depth)


@register("file_labels", orc.file_labels(None, None))
def file_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@register("file_labels_small_caps", orc.file_labels(SMALL_FILE_CAP, SMALL_COMMIT_CAP))
def file_labels_small_caps(spark, sf_dir):
    return _labels(spark, sf_dir, SMALL_FILE_CAP, SMALL_COMMIT_CAP)


@register("file_labels_shallow", orc.file_labels(None, None, SHALLOW_DEPTH))
def file_labels_shallow(spark, sf_dir):
    """The feature is the shallow history: labels from the newest commits."""
    return _labels(spark, sf_dir, depth=SHALLOW_DEPTH)


@register("label_counts", orc.label_counts(None, None))
def label_counts(spark, sf_dir):
    return lab.label_counts(_labels(spark, sf_dir))


# --- D1-D11, M4, M6, M7: dataset ------------------------------------------------

def labelled_dataset(spark, sf_dir, features=None):
    """Parsed features of the T1 files joined to their T2 labels."""
    f = features if features is not None else feat.extract_features(fx.source_files_from_part(spark, sf_dir))
    labels = _labels(spark, sf_dir)
    return ds.align(ds.attach_labels(f, labels), keep=("repo", "path"))


@register("dataset_rows", orc.dataset_rows())
def dataset_rows(spark, sf_dir):
    return labelled_dataset(spark, sf_dir)


@register("class_balance", orc.class_balance())
def class_balance(spark, sf_dir):
    return ds.class_balance(labelled_dataset(spark, sf_dir))


@register("feature_ranges", orc.feature_ranges())
def feature_ranges(spark, sf_dir):
    return ds.feature_ranges(labelled_dataset(spark, sf_dir))


@register("feature_profile", orc.feature_profile())
def feature_profile(spark, sf_dir):
    return ds.feature_profile(labelled_dataset(spark, sf_dir))


@register("class_distribution", orc.class_distribution())
def class_distribution(spark, sf_dir):
    return ds.class_distribution(labelled_dataset(spark, sf_dir))


@register("class_histogram", orc.class_histogram("cyclomatic_complexity"))
def class_histogram(spark, sf_dir):
    return ds.class_histogram(labelled_dataset(spark, sf_dir), "cyclomatic_complexity")


@register("label_correlation", orc.label_correlation())
def label_correlation(spark, sf_dir):
    return ds.label_correlation(labelled_dataset(spark, sf_dir))


@register("correlation_matrix", orc.correlation_matrix(12))
def correlation_matrix(spark, sf_dir):
    return ds.top_correlation_matrix(labelled_dataset(spark, sf_dir), 12)


@register("class_weights", orc.class_weights())
def class_weights(spark, sf_dir):
    return ds.class_weights(labelled_dataset(spark, sf_dir))


FILE_ID = ("repo", "path")


def _labelled_keys(spark, sf_dir):
    """The narrow table that ranks are made from, written once: whether a
    file parses is asked of its source a single time."""
    from riskfold.session import cut_lineage

    return cut_lineage(labelled_dataset(spark, sf_dir).select("repo", "path", "label"), "labelled")


@register("stratified_split", orc.stratified_split(0.2))
def stratified_split(spark, sf_dir):
    return ds.stratified_split(_labelled_keys(spark, sf_dir), FILE_ID, 0.2)


@register("stratified_folds", orc.stratified_folds(5))
def stratified_folds(spark, sf_dir):
    return ds.stratified_folds(_labelled_keys(spark, sf_dir), FILE_ID, 5)


# --- E1-E11, M8/M10 aggregates: evaluation ------------------------------------

@register("confusion_counts", orc.confusion_counts())
def confusion_counts(spark, sf_dir):
    c = ev.confusion_counts(fx.predictions_from_part(spark, sf_dir))
    return c.select("tn", "fp", "fn", "tp", "one_class", "true_negatives", "false_positives",
                    "false_negatives", "true_positives")


@register("normalized_confusion", orc.normalized_confusion())
def normalized_confusion(spark, sf_dir):
    return ev.normalized_confusion(fx.predictions_from_part(spark, sf_dir))


@register("class_metrics", orc.class_metrics())
def class_metrics(spark, sf_dir):
    return ev.class_metrics(fx.predictions_from_part(spark, sf_dir))


@register("classification_report", orc.classification_report())
def classification_report(spark, sf_dir):
    return ev.classification_report(fx.predictions_from_part(spark, sf_dir))


@register("roc_auc", orc.roc_auc())
def roc_auc(spark, sf_dir):
    return ev.roc_auc(fx.predictions_from_part(spark, sf_dir))


@register("roc_curve", orc.roc_curve())
def roc_curve(spark, sf_dir):
    return ev.roc_curve(fx.predictions_from_part(spark, sf_dir))


@register("fold_metrics", orc.fold_metrics())
def fold_metrics(spark, sf_dir):
    return ev.fold_metrics(fx.model_predictions_from_part(spark, sf_dir), ["model", "fold"])


@register("cv_summary", orc.cv_summary())
def cv_summary(spark, sf_dir):
    fm = ev.fold_metrics(fx.model_predictions_from_part(spark, sf_dir), ["model", "fold"])
    return ev.cv_summary(ev.metrics_long(fm, ["model", "fold"]), ["model"])


@register("model_comparison", orc.model_comparison())
def model_comparison(spark, sf_dir):
    m = ev.fold_metrics(fx.model_predictions_from_part(spark, sf_dir), ["model"])
    return ev.model_comparison(ev.metrics_long(m, ["model"]))


@register("select_best_model", orc.select_best())
def select_best_model(spark, sf_dir):
    m = ev.fold_metrics(fx.model_predictions_from_part(spark, sf_dir), ["model", "model_pos"])
    return ev.select_best(m, "f1")


# --- P2-P10, S8, S9: scoring reports ------------------------------------------

def scored_files(spark, sf_dir):
    """T1 features with the T4 scores (error rows have no score)."""
    from pyspark.sql import functions as F

    f = feat.extract_features(fx.source_files_from_part(spark, sf_dir)).drop("error")
    p = fx.predictions_from_part(spark, sf_dir).select("repo", "path", "score", "error")
    return f.join(p, ["repo", "path"])


@register("risk_report", orc.risk_report())
def risk_report(spark, sf_dir):
    return sc.risk_report(scored_files(spark, sf_dir))


@register("ranked_report", orc.ranked_report())
def ranked_report(spark, sf_dir):
    return sc.ranked_report(scored_files(spark, sf_dir))


TOP_K = 25


@register("top_risk", orc.top_risk(TOP_K))
def top_risk(spark, sf_dir):
    return sc.top_risk(scored_files(spark, sf_dir), TOP_K).select("repo", "path", "score")


@register("report_footer", orc.report_footer())
def report_footer(spark, sf_dir):
    return sc.report_footer(scored_files(spark, sf_dir))


@register("batch_summary", orc.batch_summary())
def batch_summary(spark, sf_dir):
    return sc.batch_summary(scored_files(spark, sf_dir))


@register("batch_rows", orc.batch_rows())
def batch_rows(spark, sf_dir):
    return sc.batch_rows(scored_files(spark, sf_dir))


@register("batch_csv_rows", orc.batch_csv_rows())
def batch_csv_rows(spark, sf_dir):
    return sc.batch_csv_rows(scored_files(spark, sf_dir))


@register("report_table", orc.report_table())
def report_table(spark, sf_dir):
    return sc.flat_report(scored_files(spark, sf_dir))


@register("risk_histogram", orc.risk_histogram())
def risk_histogram(spark, sf_dir):
    return sc.risk_histogram(scored_files(spark, sf_dir))


# --- X1-X6: explanations --------------------------------------------------------

def t1_features(spark, sf_dir):
    return feat.extract_features(fx.source_files_from_part(spark, sf_dir))


@register("feature_status", orc.feature_status())
def feature_status(spark, sf_dir):
    return xp.feature_status(t1_features(spark, sf_dir))


@register("recommendations", orc.recommendations())
def recommendations(spark, sf_dir):
    from pyspark.sql import functions as F

    r = xp.recommendations(t1_features(spark, sf_dir))
    return r.select("repo", "path", F.array_join("rule_ids", ",").alias("rule_ids"), F.size("rule_ids").cast("int").alias("n_rules"))


@register("recommendation_counts", orc.recommendation_counts())
def recommendation_counts(spark, sf_dir):
    return xp.recommendation_counts(xp.recommendations(t1_features(spark, sf_dir)))


@register("radar_values", orc.radar_values())
def radar_values(spark, sf_dir):
    return xp.radar_values(t1_features(spark, sf_dir))


# --- S12: generator -----------------------------------------------------------------

@register("synthetic_dataset", orc.synthetic_dataset())
def synthetic_dataset(spark, sf_dir):
    """One generated labelled row per part key (the work grows with part)."""
    from pyspark.sql import functions as F

    from riskfold.functions.columns import round_fixed
    from riskfold.sources.generate import NORMAL_COLUMNS, synthesize

    ids = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    g = synthesize(ids, "id", 0.35, "42")
    return g.select("id", *[round_fixed(F.col(c), 6).alias(c) if c in NORMAL_COLUMNS else F.col(c) for c in FEATURE_NAMES],
                    "label")


# --- M1-M3, M5, M8-M11, E9, P1: training and scoring ---------------------------
# Models, folds and grid are the reference's (``train.MODEL_DEFAULTS``,
# ``train.PARAM_GRIDS``), fitted on all labelled training rows.

KNOWN_FEATURE, KNOWN_LEAST = "num_global_variables", 3


def known_dataset(spark, sf_dir):
    """Every parsed T1 file, labelled by one of its own features (the
    module binds three global names or more).  SQL knows the label from the
    part table, and so what a learner must say that has learned it."""
    from pyspark.sql import functions as F

    label = (F.col(KNOWN_FEATURE) >= KNOWN_LEAST).cast("int")
    return ds.align(t1_features(spark, sf_dir).withColumn("label", label), keep=FILE_ID)


def _train_test(spark, sf_dir, data=None):
    from pyspark.sql import functions as F

    from riskfold.session import cut_lineage

    data = cut_lineage(labelled_dataset(spark, sf_dir) if data is None else data, "labelled")
    split = cut_lineage(ds.stratified_split(data, FILE_ID, 0.2))
    return split.where(F.col("split") == "train").drop("split"), split.where(F.col("split") == "test").drop("split")


@register("cv_random_forest", orc.known_cv_summary(5))
def cv_random_forest(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir, known_dataset(spark, sf_dir))
    _, summary = tr.cross_validate(train, "random_forest", 5)
    return summary


@register("out_of_fold_predictions", orc.known_out_of_fold(5))
def out_of_fold_predictions(spark, sf_dir):
    """M8: every labelled file, scored once, by the forest that did not see
    it; ``times`` counts its rows in the written relation."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    said = tr.out_of_fold(known_dataset(spark, sf_dir), ["random_forest"], 5)
    times = F.count(F.lit(1)).over(Window.partitionBy("repo", "path"))  # a file is one row
    return said.select("model", "repo", "path", "label", "fold", "prediction", F.col("score").between(0, 1).alias("is_share"),
                       times.alias("times"))


@register("model_test_metrics", orc.known_test_metrics(["random_forest", "gradient_boosting"]))
def model_test_metrics(spark, sf_dir):
    """Both models, five folds each, and the final fits in one run."""
    res = tr.run_training(known_dataset(spark, sf_dir), ["random_forest", "gradient_boosting"])
    return tr.metrics_table(res, spark)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)
    model = tr.fit(train, "random_forest")
    return tr.top_features(tr.feature_importance(model, spark), 15)


@register("first_important_feature", orc.known_first_feature(KNOWN_FEATURE, 10))
def first_important_feature(spark, sf_dir):
    """The feature that makes the label leads the ranking; importances
    fall from rank to rank and those of all features add up to one."""
    from pyspark.sql import functions as F

    train, _ = _train_test(spark, sf_dir, known_dataset(spark, sf_dir))
    everything = tr.feature_importance(tr.fit(train, "random_forest"), spark)  # thirty rows
    top = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("least"), "idx", "feature")))
    shares = F.transform(top, lambda x: -x["least"])
    return everything.agg(
        top[0]["feature"].alias("feature"), F.size(F.slice(top, 1, 10)).alias("n_listed"),
        (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        (shares[0] > 2 * shares[1]).alias("leads"), F.count(F.lit(1)).alias("n_features"))


@register("grid_search_random_forest", orc.known_grid(3))
def grid_search_random_forest(spark, sf_dir):
    """M9: the eight points of the grid in their ranking, and the test metrics
    of the best one, fitted on all training rows."""
    from pyspark.sql import functions as F

    train, test = _train_test(spark, sf_dir, known_dataset(spark, sf_dir))
    found = tr.grid_search(train, "random_forest", 3)
    tested = tr.evaluate_model(found.model, test)["metrics"].select(
        F.lit(1).alias("rank"), F.col("accuracy").alias("test_accuracy"), F.col("f1").alias("test_f1"), F.col("roc_auc").alias("test_auc"))
    return found.ranking.join(F.broadcast(tested), "rank", "left")  # a row a point


@register("evaluate_held_out", orc.known_report())
def evaluate_held_out(spark, sf_dir):
    train, test = _train_test(spark, sf_dir, known_dataset(spark, sf_dir))
    model = tr.fit(train, "gradient_boosting")
    return tr.evaluate_model(model, test)["report"]


def _scored_corpus(spark, sf_dir):
    """Every parsed file with the score of a forest fitted on the labelled
    ones, and the three factors of that forest.  Files are parsed once: the
    same feature table feeds training and scoring."""
    from pyspark.sql import functions as F

    from riskfold.session import cut_lineage

    features = cut_lineage(t1_features(spark, sf_dir))
    split = cut_lineage(ds.stratified_split(labelled_dataset(spark, sf_dir, features), FILE_ID, 0.2))
    model = tr.fit(split.where(F.col("split") == "train").drop("split"), "random_forest")
    factors = sc.top_factor_names(tr.feature_importance(model, spark), 3)
    return tr.score_files(model, features), factors


@register("score_corpus")
def score_corpus(spark, sf_dir):
    """P1 + P4: train on the labelled files, then score every parsed file
    with its risk level and top-3 factors."""
    scored, factors = _scored_corpus(spark, sf_dir)
    return sc.scored_report(scored, factors)


@register("scored_corpus_proof", orc.scored_corpus_proof())
def scored_corpus_proof(spark, sf_dir):
    """P1 + P4, file by file: whether level and flag follow from the unrounded
    score, the reported score is it rounded, each factor's value is the file's
    own, and the factors are the same three of every file."""
    from pyspark.sql import functions as F

    from riskfold.session import cut_lineage

    scored, factors = _scored_corpus(spark, sf_dir)
    scored = cut_lineage(scored, "scored")
    report = sc.scored_report(scored, factors)
    s, names = F.col("score"), [name for name, _ in factors]
    level = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]),
                         (s >= 0.3).cast("int") + (s >= 0.6).cast("int") + (s >= 0.8).cast("int") + 1)
    own = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    said = F.transform("top_factors", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    shares = F.col("top_factors.importance")
    facts = scored.select("repo", F.col("path").alias("file_path"), "score", level.alias("level"), own.alias("own"), "total_lines")
    both = report.join(facts, ["repo", "file_path"])
    return both.select(
        "repo", F.col("file_path").alias("path"), s.between(0, 1).alias("is_share"), (F.col("risk_level") == F.col("level")).alias("level_follows"),
        (F.col("flagged") == (s >= 0.6)).alias("flag_follows"), (F.abs(F.col("risk_score") - s) <= 0.00005000001).alias("rounded"),
        (said == F.col("own")).alias("own_values"), ((shares[0] >= shares[1]) & (shares[1] >= shares[2])).alias("ranked"),
        (F.col("features.total_lines") == F.col("total_lines")).alias("own_features"))


@register("roc_trapezoid_auc", orc.roc_trapezoid_auc())
def roc_trapezoid_auc(spark, sf_dir):
    from pyspark.sql import functions as F

    a = ev.trapezoid_auc(fx.predictions_from_part(spark, sf_dir))
    from riskfold.functions.columns import round_fixed

    return a.select(round_fixed(F.col("auc"), 6).alias("auc"))


# --- S5-S7, S10: sinks and persistence round trips -----------------------------

def _scratch(spark, name):
    """A fresh folder under the session's checkpoint directory (the shared
    folder on a cluster)."""
    import uuid

    from riskfold.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex}"


@register("feature_table_csv_round_trip", orc.feature_table_csv())
def feature_table_csv_round_trip(spark, sf_dir):
    """S6 then S5: write the labelled table as CSV with a header, read it
    back by column name."""
    from riskfold.sources.tables import read_feature_table, write_feature_table

    path = _scratch(spark, "features-csv")
    write_feature_table(labelled_dataset(spark, sf_dir), path)
    return read_feature_table(spark, path)


JSON_FACTORS = [("cyclomatic_complexity", 0.5), ("comment_ratio", 0.25), ("num_global_variables", 0.125)]


@register("report_json_round_trip", orc.report_json(JSON_FACTORS))
def report_json_round_trip(spark, sf_dir):
    """The nested report (factors array, features struct) as JSON lines,
    read back by its declared schema and flattened to the S8 table with the
    name, value and importance of each factor."""
    from pyspark.sql import functions as F

    from riskfold.sources.tables import read_report_json, write_report_json

    path = _scratch(spark, "report-json")
    write_report_json(sc.scored_report(scored_files(spark, sf_dir), JSON_FACTORS), path)
    f = F.col("top_factors")
    factors = [f[i][c].alias(f"factor_{i + 1}_{c}") for i in range(3) for c in ("feature", "value", "importance")]
    return read_report_json(spark, path).select(
        "repo", "file_path", "risk_score", "risk_level", "flagged", "features.*", "error", F.size(f).alias("n_factors"), *factors)


@register("report_csv_round_trip", orc.report_csv())
def report_csv_round_trip(spark, sf_dir):
    """The flat report written riskiest first over several CSV files and
    read back by its declared schema, with the place of each row."""
    from riskfold.schema import FLAT_REPORT
    from riskfold.session import cut_lineage
    from riskfold.sources.tables import read_report_csv, report_order, write_report_csv

    path = _scratch(spark, "report-csv")
    table = cut_lineage(sc.flat_report(scored_files(spark, sf_dir)), "report")  # sorting samples its input
    write_report_csv(table, path, report_order("risk_score", "repo", "file_path"))
    return read_report_csv(spark, path, FLAT_REPORT, "position")


@register("batch_csv_round_trip", orc.batch_csv())
def batch_csv_round_trip(spark, sf_dir):
    """The batch report, written and read back in the same way."""
    from riskfold.schema import BATCH_REPORT
    from riskfold.session import cut_lineage
    from riskfold.sources.tables import read_report_csv, report_order, write_report_csv

    path = _scratch(spark, "batch-csv")
    table = cut_lineage(sc.batch_csv_rows(scored_files(spark, sf_dir)), "batch")
    write_report_csv(table, path, report_order("risk_score", "repo", "filename"))
    return read_report_csv(spark, path, BATCH_REPORT, "position")


SOME_REPOS = ["NATION_3", "NATION_17"]


def _as_lines(df, columns, cut):
    """JSON lines by repo; those that ``cut`` names are broken off."""
    from pyspark.sql import functions as F

    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select("repo", F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@register("sources_read_back", orc.sources_read_back(SOME_REPOS))
def sources_read_back(spark, sf_dir):
    """Sources as JSON lines in a folder for each repo, some lines broken
    off; all of them read back, and then two repos alone."""
    from pyspark.sql import functions as F

    from riskfold.sources.files import read_sources, write_by_repo

    path = _scratch(spark, "sources")
    t1 = fx.source_files_from_part(spark, sf_dir)
    cut = F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 101 == 0
    write_by_repo(_as_lines(t1, ["path", "source"], cut), path, "text")
    whole = read_sources(spark, path, "json").withColumn("scope", F.lit("all"))
    some = read_sources(spark, path, "json", repos=SOME_REPOS).withColumn("scope", F.lit("some"))
    n_lines = F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit("")))
    return whole.unionByName(some).select("scope", "repo", "path", n_lines.cast("int").alias("n_lines"), "error")


@register("history_read_back", orc.history_read_back(SOME_REPOS))
def history_read_back(spark, sf_dir):
    """Commits (JSON lines, some broken off) and changed files (Parquet),
    both in a folder for each repo; every commit read back with its number of
    changed files, then those of two repos alone."""
    from pyspark.sql import functions as F

    from riskfold.sources.files import read_commit_files, read_commits, write_by_repo

    commits, files = fx.history_from_orders(spark, sf_dir)
    at, changed_at = _scratch(spark, "commits"), _scratch(spark, "commit-files")
    columns = ["commit_id", "message", "authored_at", "committed_at", "n_parents"]
    write_by_repo(_as_lines(commits, columns, F.col("commit_id") % 97 == 0), at, "text")
    write_by_repo(files, changed_at)

    def scope(name, repos):
        changed = read_commit_files(spark, changed_at, repos=repos).groupBy("repo", "commit_id").agg(F.count(F.lit(1)).alias("n_files"))
        found = read_commits(spark, at, "json", repos=repos).join(changed, ["repo", "commit_id"], "left")
        return found.select(F.lit(name).alias("scope"), "repo", "commit_id", "message", F.date_format("authored_at", "yyyy-MM-dd").alias("day"),
                            "n_parents", "n_files", "error")
    return scope("all", None).unionByName(scope("some", SOME_REPOS))


@register("scanned_sources", orc.features_t1())
def scanned_sources(spark, sf_dir):
    """Every T1 module written as a file of its own, the directory scanned
    (a folder for each repo), and the features of what was found."""
    from pyspark.sql import functions as F

    from riskfold.sources.files import scan_source_files, write_source_files

    root = _scratch(spark, "tree")
    # a module that comes twice is two files; a repo without a name has the
    # folder that Spark gives it; files of no bytes are not listed
    folder = F.coalesce(F.url_encode(F.nullif("repo", F.lit(""))), F.lit("__HIVE_DEFAULT_PARTITION__"))
    numbered = F.concat(F.regexp_replace("path", "[.]py$", "."), F.monotonically_increasing_id(), F.lit(".py"))
    t1 = fx.source_files_from_part(spark, sf_dir)
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("\n"))
    write_source_files(t1.select(folder.alias("repo"), numbered.alias("path"), source.alias("source")), root)
    found = scan_source_files(spark, root, by_folder=True).select(
        F.url_decode("repo").alias("repo"), F.regexp_replace("path", "[.][0-9]+[.]py$", ".py").alias("path"), "content")
    return feat.extract_features(found, "content").select("repo", "path", *FEATURE_NAMES)


@register("union_of_repos", orc.union_of_repos())
def union_of_repos(spark, sf_dir):
    """Feature tables of three groups of repos, one without two of the
    features, one with a column of its own, one empty, and a missing one, read
    as a single aligned table."""
    from pyspark.sql import functions as F

    from riskfold.session import cut_lineage
    from riskfold.sources.tables import read_feature_tables

    root = _scratch(spark, "repos")
    data = cut_lineage(labelled_dataset(spark, sf_dir), "labelled")
    long_name = F.length("repo") > 6
    tables = {"short": data.where(~long_name).drop("num_imports", "comment_ratio"), "long": data.where(long_name).withColumn("reviewer", F.lit("x")),
              "none": data.where("false")}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    return read_feature_tables(spark, [f"{root}/{name}" for name in (*tables, "missing")])


@register("parser_isolation", orc.parser_isolation())
def parser_isolation(spark, sf_dir):
    """files that break the parser in every known way; each becomes a row
    with its line counts, and none stops the others."""
    from pyspark.sql import functions as F

    f = feat.extract_features(fx.broken_files_from_part(spark, sf_dir), "content")
    return f.select("repo", "path", "total_lines", "comment_lines", "num_global_variables", "syntax_error", F.col("error").isNotNull().alias("failed"))


@register("recommendation_messages", orc.recommendation_messages(fx.WIDE))
def recommendation_messages(spark, sf_dir):
    """Rules and messages over T9, which reaches all nine rules."""
    from pyspark.sql import functions as F

    r = xp.recommendations(fx.wide_features_from_part(spark, sf_dir))
    return r.select("repo", "path", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("messages", "\n").alias("messages"))


@register("status_of_wide_features", orc.status_of_wide_features(fx.WIDE))
def status_of_wide_features(spark, sf_dir):
    """X1 over T9, which reaches every band: files of each status."""
    from pyspark.sql import functions as F

    st = xp.feature_status(fx.wide_features_from_part(spark, sf_dir)).where(F.col("status") != "\u2014")
    return st.groupBy("feature", "status").agg(F.count(F.lit(1)).alias("n_files"))


@register("model_save_load", orc.model_save_load())
def model_save_load(spark, sf_dir):
    """Whether a fitted model and its saved and reloaded copy give every
    file the same score."""
    from pyspark.sql import functions as F

    from riskfold.session import cut_lineage

    feats = cut_lineage(t1_features(spark, sf_dir), "features")  # files are parsed once, for training and scoring
    train, _ = _train_test(spark, sf_dir, labelled_dataset(spark, sf_dir, feats))
    model = tr.fit(train, "gradient_boosting")
    path = _scratch(spark, "model")
    tr.save_model(model, path, {"note": "round trip"})
    loaded, _, _ = tr.load_model(path)
    a = tr.score_files(model, feats).select("repo", "path", F.col("score").alias("score_fitted"))
    b = tr.score_files(loaded, feats).select("repo", "path", F.col("score").alias("score_loaded"))
    both = a.join(b, ["repo", "path"])
    return both.select("repo", "path", F.col("score_fitted").eqNullSafe(F.col("score_loaded")).alias("same_score"))


@register("ast_node_counts", orc.ast_node_counts())
def ast_node_counts(spark, sf_dir):
    """the public node relation, counted per file and node type."""
    from riskfold.operators.parse import parse_sources

    return feat.node_type_counts(parse_sources(fx.source_files_from_part(spark, sf_dir)))


@register("hash_split", orc.hash_split(0.2))
def hash_split(spark, sf_dir):
    d = labelled_dataset(spark, sf_dir).select("repo", "path", "label")
    return ds.hash_split(d, FILE_ID, 0.2)


@register("mined_dataset", orc.mined_dataset())
def mined_dataset(spark, sf_dir):
    """The mining flow over the whole history and all files: labels, then
    features of the labelled files only."""
    from riskfold.plans import jobs

    commits, files = fx.history_from_orders(spark, sf_dir)
    return jobs.mine_dataset(fx.source_files_from_part(spark, sf_dir), commits, files, fx.AS_OF)
