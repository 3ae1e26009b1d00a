"""

Every query takes (spark, folder of parquet tables) and reads whole tables. The
oracle text of the same name says the same in plain SQL.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path
from zlib import crc32

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fixtures import fixture  # noqa: E402
from ledgerloom.functions.labels import (  # noqa: E402
    as_indicators,
    binary_label,
    signed_label,
    to_number,
)
from ledgerloom.models import evaluation, glm, scoring, stored  # noqa: E402
from ledgerloom.models.design import assemble, design  # noqa: E402
from ledgerloom.models.group_lasso import group_lasso_cv, selected_groups  # noqa: E402
from ledgerloom.models.newton import fit_matrix  # noqa: E402
from ledgerloom.models.passes import RowBlocks, column_sums  # noqa: E402
from ledgerloom.models.penalized import (  # noqa: E402
    coef_path,
    nonzero,
    penalized_cv,
    penalized_cvs,
    penalty_grid,
    split_by_size,
)
from ledgerloom.models.split import train_test  # noqa: E402
from ledgerloom.models.stepwise import stepwise, stepwise_all  # noqa: E402
from ledgerloom.models.tree import tree_cv  # noqa: E402
from ledgerloom.models.wide import wide_design, wide_path  # noqa: E402
from ledgerloom.operators.aggregates import mean_sd, percent_where  # noqa: E402
from ledgerloom.operators.columns import (  # noqa: E402
    as_levels,
    column_fill,
    drop_all_null,
    drop_matching,
    fill,
)
from ledgerloom.operators.filters import where_abs_over  # noqa: E402
from ledgerloom.operators.joins import exclude_keys  # noqa: E402
from ledgerloom.operators.ordering import first_rows  # noqa: E402
from ledgerloom.operators.sets import stack_results, union_sources  # noqa: E402
from ledgerloom.operators.windows import row_id  # noqa: E402
from ledgerloom.sources.files import read_csv  # noqa: E402
from ledgerloom.sources.frames import rows_to_df  # noqa: E402
from ledgerloom.plans import contributions as contrib  # noqa: E402
from ledgerloom.plans import onboarding, reconciliation as recon  # noqa: E402
from ledgerloom.plans import survey as surveys  # noqa: E402
from ledgerloom.storage import shared_folder  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

# the training-text operators are an optional part: without them the rest works
try:
    from ledgerloom.llm.queries import ORACLE as LLM_ORACLE  # noqa: E402
    from ledgerloom.llm.queries import QUERIES as LLM_QUERIES  # noqa: E402
except ModuleNotFoundError as missing:
    if not str(missing.name).startswith("ledgerloom.llm"):
        raise
    LLM_QUERIES, LLM_ORACLE = {}, {}
try:
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL  # noqa: E402
    from corpus_pipeline import run as pipeline  # noqa: E402

    LLM_QUERIES = LLM_QUERIES | {"pipeline": pipeline}
    if PIPELINE_SQL is not None:
        LLM_ORACLE = LLM_ORACLE | {"pipeline": PIPELINE_SQL}
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not str(missing.name).startswith("ledgerloom.llm"):
        raise

# --- fixed parameters of the registered queries -----------------------------

YEARS = (1996, 1997, 1998, 1999, 2000)
LAYERS = {
    "ingested": ("layer_ingested", "meta_lineage_source_name"),
    "standardized": ("layer_standardized", "meta_lineage_source_name"),
    "shared": ("layer_shared", "FileName"),
}
COHORTS = {"A": ["BUILDING", "MACHINERY"], "B": ["AUTOMOBILE", "FURNITURE"]}
TITLES = {"A": "Received by cohort A", "B": "Received by cohort B"}
RULES = [("Plates", ["plate"]), ("Goods", ["widget", "red"]), ("Committees", [])]
CUTS = [(6_000_000, "Large"), (3_000_000, "Medium")]
SMALLEST = "Small"
HOME, NEAR = "NATION_0", [f"NATION_{i}" for i in range(1, 9)]
PLACES = ("Home", "Near", "Other")
TERMS = [
    "age", "country", "job_role", "experience_years", "remote_hours",
    "job_satisfaction", "tech_tools", "company_size", "salary",
]
TWO = ["job_satisfaction", "remote_hours"]
GROUPS = {
    "person": ["age"],
    "work": ["experience_years", "remote_hours"],
    "setting": ["job_satisfaction", "tech_tools"],
}
# three given models, to be scored without a fit
MODELS = {
    "full": {
        "(Intercept)": -7.5, "job_satisfaction": 0.9, "remote_hours": 0.12,
        "age": -0.01, "company_size=small": 0.25, "country=ASIA": -0.4,
    },
    "short": {"(Intercept)": -6.0, "job_satisfaction": 0.7, "remote_hours": 0.1},
    "never": {"(Intercept)": -9.0, "tech_tools": 0.01},
}


# --- helpers ----------------------------------------------------------------


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _cohort(spark: SparkSession, sf: str, cohort: str) -> DataFrame:
    return contrib.cohort_rows(fixture(spark, sf, "contributions"), COHORTS[cohort])


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    schemas = fixture(spark, sf, "catalog_schemas")
    tables = fixture(spark, sf, "catalog_tables")
    links = onboarding.account_link_from_rows(tables, fixture(spark, sf, "crosswalk_rows"))
    return schemas, tables, links


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return onboarding.status(*_catalog(spark, sf))


def _survey(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "survey")


def _full_design(spark: SparkSession, sf: str, intercept: bool = True):
    return design(_survey(spark, sf), "preference", TERMS, intercept)


def _given_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _survey(spark, sf)
    columns = as_indicators({t for m in MODELS.values() for t in m if t != "(Intercept)"})
    return df.select(
        "row_id",
        F.col("preference").alias("actual"),
        *[
            scoring.probability(scoring.linear_score(m, columns)).alias(name)
            for name, m in MODELS.items()
        ],
    )


def _given_metrics(spark: SparkSession, sf: str) -> DataFrame:
    classes = scoring.classify_models(_given_scores(spark, sf), list(MODELS))
    return evaluation.metrics(evaluation.confusion(classes, list(MODELS), "actual"))


# --- (a) file reconciliation ------------------------------------------------


def acq_files_by_month(spark, sf):
    return recon.files_by_period(
        fixture(spark, sf, "acquisition"), "month", YEARS, partner="TP", feed="835"
    )


def acq_files_by_year(spark, sf):
    # the underscore is a wildcard; the blank feed keeps every feed
    return recon.files_by_period(
        fixture(spark, sf, "acquisition"), "year", YEARS, partner="TP_B", feed=""
    )


def _layer_query(layer: str, grain: str) -> Query:
    def run(spark, sf):
        table, name_col = LAYERS[layer]
        return recon.layer_files_by_period(
            fixture(spark, sf, "acquisition"), fixture(spark, sf, table), grain, name_col,
            partner="TP_A", feed="835",
        )

    return run


def ingested_files_both_grains(spark, sf):
    return recon.layer_files_both(
        fixture(spark, sf, "acquisition"), fixture(spark, sf, "layer_ingested"),
        partner="TP_A", feed="835",
    )


def layer_coverage_by_year(spark, sf):
    return _coverage(spark, sf, "year")


def layer_coverage_by_month(spark, sf):
    return _coverage(spark, sf, "month")


def _coverage(spark, sf, grain):
    layers = {k: (fixture(spark, sf, t), c) for k, (t, c) in LAYERS.items()}
    result = recon.coverage(fixture(spark, sf, "acquisition"), layers, grain)
    return _rounded(result, 6, *[f"{k}_coverage" for k in LAYERS])


def layer_list_by_year(spark, sf):
    """A layer that is stored as two tables of different columns: files by year in
    both, and in one of them alone."""
    layer, name = fixture(spark, sf, "layer_ingested"), F.col("meta_lineage_source_name")
    both = union_sources(
        {
            "packed": layer.where(name.endswith(".bz2")).withColumn("packer", F.lit("bzip2")),
            "plain": layer.where(~name.endswith(".bz2")),
        }
    )
    parts = {"all": both, "packed": both.where("source_table = 'packed'")}
    return stack_results(
        [
            recon.layer_files_by_period(
                fixture(spark, sf, "acquisition"), rows, "year", "meta_lineage_source_name",
                partner="TP_A", feed="835",
            ).select(F.lit(label).alias("tables"), "period", "unique_file_paths")
            for label, rows in parts.items()
        ]
    )


# --- (b) onboarding ---------------------------------------------------------


def catalog_typed_inventory(spark, sf):
    return onboarding.typed_inventory(fixture(spark, sf, "catalog_tables"))


def ingested_feed_types(spark, sf):
    return onboarding.ingested_types(fixture(spark, sf, "catalog_tables"))


def account_link_status(spark, sf):
    _, tables, links = _catalog(spark, sf)
    return onboarding.attach_link(links, tables)


def schema_has_tables(spark, sf):
    schemas, tables = fixture(spark, sf, "catalog_schemas"), fixture(spark, sf, "catalog_tables")
    layers = (F.col("schema_name").contains("shared")) | (
        F.col("schema_name").contains("standardized")
    )
    return onboarding.schema_flags(schemas.where(layers), tables, "__")


def onboarding_type_labels(spark, sf):
    _, tables, links = _catalog(spark, sf)
    return onboarding.type_comparison(tables, links)


def onboarding_status(spark, sf):
    return _status(spark, sf)


def onboarding_funnel(spark, sf):
    return onboarding.funnel(_status(spark, sf))


def shared_not_linked(spark, sf):
    return onboarding.shared_not_linked(_status(spark, sf))


def shared_not_linked_pairs(spark, sf):
    """Shared lines less those whose partner and type are linked on any line."""
    lines = _status(spark, sf)
    linked = lines.where("account_linking_completed = 'True'")
    pair = ["trading_partner_id", "table_type_ingested"]
    shared = lines.where("shared_completed = 'True'").select(*pair, "shared_completed")
    return exclude_keys(shared, linked, pair)


def linked_by_type(spark, sf):
    return onboarding.stage_counts(
        _status(spark, sf), "account_linking_completed", "True", "total_linked"
    )


# --- (c) contributions ------------------------------------------------------


def contrib_by_code(spark, sf):
    named = fixture(spark, sf, "contributions").withColumnsRenamed(
        {"filer": "Filer", "contributor_code": "ContributorCode", "amount": "Amount"}
    )
    rows = fill(drop_matching(contrib.cohort_rows(named, COHORTS["A"], "Filer"), "_"), "")
    totals = contrib.by_code(rows, "ContributorCode", "Amount")
    return first_rows(_doubles(totals, "total_amount"), 5, ["ContributorCode"])


def contrib_org_columns(spark, sf):
    return column_fill(contrib.organizations(_cohort(spark, sf, "A")))


def contrib_org_rows(spark, sf):
    """Rows of organizations, without the columns that hold no value among them."""
    return _doubles(drop_all_null(contrib.organizations(_cohort(spark, sf, "A"))), "amount")


def contributions_from_csv(spark, sf):
    """Rows and total by code, of rows that went through a CSV file."""
    rows = _cohort(spark, sf, "A").select("filer", "contributor_code", F.col("amount").alias("amount "))
    made_by = f"{spark.sparkContext.applicationId}-{crc32(sf.encode()):08x}"
    path = f"{shared_folder(spark)}/contributions-{made_by}"
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    read = read_csv(spark, path, {"amount": "decimal(18,2)"}, trim_names=True, strict=True)
    return _doubles(contrib.by_code(read), "total_amount")


def contrib_org_totals(spark, sf):
    return _doubles(contrib.org_totals(_cohort(spark, sf, "A")), "total_amount")


def contrib_by_contributor(spark, sf):
    return _doubles(contrib.contributor_totals(_cohort(spark, sf, "A")), "total_amount")


def contrib_individuals(spark, sf):
    people = contrib.donors(_cohort(spark, sf, "A")).where("not is_org")
    return _doubles(people.select("contributor_last", "total_amount"), "total_amount")


def contrib_individuals_anti(spark, sf):
    rows = _cohort(spark, sf, "A")
    people = contrib.individuals(contrib.contributor_totals(rows), contrib.org_totals(rows))
    return _doubles(people, "total_amount")


def contrib_industry_share(spark, sf):
    orgs = contrib.org_totals(_cohort(spark, sf, "A"))
    return _doubles(contrib.industry_totals(orgs, RULES), "total_amount")


def _people(spark, sf):
    return contrib.donors(_cohort(spark, sf, "A")).where("not is_org")


def contrib_size_bins(spark, sf):
    return _doubles(contrib.size_bins(_people(spark, sf), CUTS, SMALLEST), "total_amount")


def contrib_combined_share(spark, sf):
    return _doubles(
        contrib.combined(_cohort(spark, sf, "A"), RULES, CUTS, SMALLEST), "total_amount"
    )


def contrib_stacked_share(spark, sf):
    orgs = contrib.org_totals(_cohort(spark, sf, "A"))
    stacked = contrib.stacked(
        contrib.industry_totals(orgs, RULES), contrib.size_bins(_people(spark, sf), CUTS, SMALLEST)
    )
    return _doubles(stacked, "total_amount")


def contrib_city_totals(spark, sf):
    return _doubles(contrib.city_totals(_cohort(spark, sf, "A")), "total_amount")


def contrib_city_class(spark, sf):
    return _doubles(
        contrib.city_classes(_cohort(spark, sf, "A"), HOME, NEAR, PLACES), "total_amount"
    )


def contrib_city_class_normalized(spark, sf):
    return _doubles(
        contrib.city_classes(_cohort(spark, sf, "B"), HOME, NEAR, PLACES, normalize=True),
        "total_amount",
    )


def contrib_cohort_totals(spark, sf):
    return _doubles(
        contrib.cohort_totals(fixture(spark, sf, "contributions"), COHORTS, TITLES), "total_amount"
    )


# --- (d) survey tables, scores and metrics ----------------------------------


def pref_share_overall(spark, sf):
    return _rounded(
        surveys.preference_shares(_survey(spark, sf), "country", within=False), 6, "share"
    )


def pref_share_within(spark, sf):
    return _rounded(surveys.preference_shares(_survey(spark, sf), "job_role"), 6, "share")


def pref_subset_stats(spark, sf):
    stats = surveys.subset_stats(
        _survey(spark, sf), "job_role", "BUILDING", "preference", 1, "age"
    )
    return _rounded(stats, 6, "percent", "mean", "sd")


def pref_percent(spark, sf):
    return _rounded(
        percent_where(
            _survey(spark, sf), F.col("country") == "ASIA", F.col("preference") == 1
        ),
        6,
        "percent",
    )


def satisfied_hours_mean_sd(spark, sf):
    stats = mean_sd(_survey(spark, sf), F.col("job_satisfaction") >= 8, "remote_hours")
    return _rounded(stats, 6, "mean", "sd")


def train_test_split_sizes(spark, sf):
    df = _survey(spark, sf).select("row_id")
    train, test = train_test(df, "row_id", 0.2, seed=100)
    return (
        train.select(F.lit("train").alias("part"))
        .unionAll(test.select(F.lit("test").alias("part")))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def train_test_repeated_ids(spark, sf):
    """A split by an id of few values keeps its exact size."""
    df = _survey(spark, sf).select((F.col("row_id") % 3).alias("few"), "row_id")
    df = df.withColumn("few", F.when(F.col("few") > 0, F.col("few")))
    train, test = train_test(df, "few", 0.2, seed=100)
    both = train.select(F.lit("train").alias("part"), "row_id").unionAll(
        test.select(F.lit("test").alias("part"), "row_id")
    )
    return both.groupBy("part").agg(F.count_distinct("row_id").alias("n_rows"))


def survey_row_numbers(spark, sf):
    return row_id(_survey(spark, sf).select("row_id", "age"), ["age", "row_id"])


def survey_recoded(spark, sf):
    """Labels as 0 and 1 and as -1 and 1, numbers out of text, given levels."""
    df = _survey(spark, sf)
    text = F.when(F.col("row_id") % 2 == 0, F.col("salary").cast("string")).otherwise("none")
    return as_levels(df, "country", ["ASIA", "EUROPE"]).select(
        "row_id",
        binary_label(F.col("company_size"), "small").alias("is_small"),
        signed_label(F.col("preference")).alias("signed"),
        to_number(text).alias("number"),
        F.col("country").alias("known_country"),
    )


def score_given_model(spark, sf):
    return _rounded(_given_scores(spark, sf), 6, *MODELS)


def mean_probability(spark, sf):
    scores = _given_scores(spark, sf)
    return _rounded(evaluation.mean_probability(scores, list(MODELS)), 6, "avg_probability")


def classify_last_ten(spark, sf):
    return scoring.last_classes(_given_scores(spark, sf), list(MODELS), ["row_id"])


def classification_metrics(spark, sf):
    return _rounded(_given_metrics(spark, sf), 6, "accuracy", "precision", "recall", "f1")


def best_recall_model(spark, sf):
    best = evaluation.best_recall(_given_metrics(spark, sf)).select("model", "recall")
    return _rounded(best, 6, "recall")


# --- (d) fitted models ------------------------------------------------------


def _two_column_fit(spark, sf):
    d = design(_survey(spark, sf), "preference", TWO)
    return d, glm.fit_logistic(d)


def glm_two_predictors(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    table = fit.coefficients(spark).select("term", "estimate", "std_error", "z_value")
    return _rounded(table, 4, "estimate", "std_error", "z_value")


def glm_odds_two(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    return _rounded(glm.odds_ratios(fit.coefficients(spark)), 4, "odds_ratio", "percent_change")


def glm_significant_two(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    table = where_abs_over(glm.significant(fit.coefficients(spark), 0.01), "z_value", 2.0)
    return _rounded(table.select("term", "z_value"), 4, "z_value")


def lasso_nonzero_two(spark, sf):
    d = design(_survey(spark, sf), "preference", TWO, intercept=False)
    path = coef_path(d, "row_id", 1.0, [0.02], tol=1e-9).path(spark)
    return _rounded(nonzero(path).select("term", "coefficient"), 4, "coefficient")


def glm_two_designs(spark, sf):
    """The same model from a formula and from a matrix with a constant column."""
    _, by_formula = _two_column_fit(spark, sf)
    with_constant = _survey(spark, sf).withColumn("(Intercept)", F.lit(1.0))
    plain = assemble(with_constant, "preference", ["(Intercept)", *TWO], intercept=False)
    a = by_formula.coefficients(spark).select("term", F.col("estimate").alias("by_formula"))
    b = (
        fit_matrix(plain)
        .coefficients(spark, plain.names)
        .select("term", F.col("estimate").alias("by_matrix"))
    )
    return _rounded(a.join(b, "term"), 4, "by_formula", "by_matrix")


def glm_deviance(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    return _rounded(glm.deviance_table(spark, fit), 4, "deviance")


def glm_criteria(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    table = glm.information_criteria(spark, {"two predictors": fit})
    return _rounded(table, 4, "deviance", "aic", "bic")


def lrt_null_vs_two(spark, sf):
    _, fit = _two_column_fit(spark, sf)
    table = glm.likelihood_ratio(spark, (fit.null_deviance, 1), (fit.deviance, fit.rank))
    return _rounded(table, 4, "statistic", "p_value")


def glm_summary(spark, sf):
    return glm.fit_logistic(_full_design(spark, sf)).coefficients(spark)


def glm_odds(spark, sf):
    return glm.odds_ratios(glm_summary(spark, sf))


def glm_significant(spark, sf):
    return where_abs_over(glm.significant(glm_summary(spark, sf), 0.01), "z_value", 2.0)


def step_both_significant(spark, sf):
    chosen = stepwise(_full_design(spark, sf), direction="both")
    return glm.significant(chosen.coefficients(spark), 0.01)


def _step(direction: str) -> Query:
    def run(spark, sf):
        return stepwise(_full_design(spark, sf), direction=direction).steps(spark)

    return run


def _step_two(direction: str) -> Query:
    def run(spark, sf):
        chosen = stepwise(design(_survey(spark, sf), "preference", TWO), direction=direction)
        return _rounded(chosen.steps(spark), 4, "deviance", "aic", "bic")

    return run


def lrt_full_vs_reduced(spark, sf):
    d = _full_design(spark, sf)
    chosen = stepwise(d, direction="both")
    full = chosen.path[0][2]
    return glm.likelihood_ratio(
        spark, (chosen.fit.deviance, chosen.fit.rank), (full.deviance, full.rank)
    )


def tree_accuracy(spark, sf):
    return tree_cv(design(_survey(spark, sf), "preference", TERMS), "row_id").results(spark)


def tree_document_quality(spark, sf):
    d = design(fixture(spark, sf, "document_quality"), "quality", ["n_chars", "lang", "source"])
    return tree_cv(d, "doc_id").results(spark)


def _penalized(spark, sf, alpha):
    return penalized_cv(_full_design(spark, sf, intercept=False), "row_id", alpha)


def ridge_path(spark, sf):
    return _penalized(spark, sf, 0.0).path(spark)


def lasso_path(spark, sf):
    return _penalized(spark, sf, 1.0).path(spark)


def enet_path(spark, sf):
    return _penalized(spark, sf, 0.5).path(spark)


def lasso_cv(spark, sf):
    return _penalized(spark, sf, 1.0).cv_table(spark)


def lasso_selected(spark, sf):
    return nonzero(_penalized(spark, sf, 1.0).at_best(spark))


def coef_magnitudes(spark, sf):
    return split_by_size(_penalized(spark, sf, 0.0).at_best(spark))


def _fixed_penalty(alpha: float, lam: float) -> Query:
    def run(spark, sf):
        d = design(_survey(spark, sf), "preference", TWO, intercept=False)
        return _rounded(coef_path(d, "row_id", alpha, [lam], tol=1e-9).path(spark), 4, "coefficient")

    return run


def group_lasso_fixed_penalty(spark, sf):
    d = assemble(_survey(spark, sf), "preference", TWO)
    path = group_lasso_cv(d, "row_id", {"both": TWO}, folds=0, lambdas=[0.02], tol=1e-9)
    return _rounded(path.path(spark), 4, "coefficient")


def lasso_penalty_grid(spark, sf):
    d = design(_survey(spark, sf), "preference", ["age", "salary", *TWO], intercept=False)
    grid = penalty_grid(d, "row_id", 1.0)
    rows = rows_to_df(spark, enumerate(grid), "step bigint, lambda double")
    return _rounded(rows, 6, "lambda")


def _cv_two(alpha: float, lambdas: list[float]) -> Query:
    """Cross-validated deviance with folds given by a column."""

    def run(spark, sf):
        df = _survey(spark, sf).withColumn("third", (F.col("row_id") % 3).cast("int"))
        d = design(df, "preference", TWO, intercept=False)
        path = penalized_cv(
            d, "row_id", alpha, folds=3, lambdas=lambdas, tol=1e-9, fold_col="third"
        )
        return _rounded(path.cv_table(spark), 4, "deviance", "std_error")

    return run


def group_lasso_cv_two(spark, sf):
    df = _survey(spark, sf).withColumn("third", (F.col("row_id") % 3).cast("int"))
    path = group_lasso_cv(
        assemble(df, "preference", TWO), "row_id", {"both": TWO}, folds=3, lambdas=[0.05, 0.01],
        tol=1e-9, fold_col="third",
    )
    return _rounded(path.cv_table(spark), 4, "deviance", "std_error")


def coef_sizes_two(spark, sf):
    d = design(_survey(spark, sf), "preference", TWO, intercept=False)
    path = coef_path(d, "row_id", 0.0, [0.1], tol=1e-9).path(spark).select("term", "coefficient")
    return _rounded(split_by_size(path, 0.1), 4, "coefficient")


def factor_design_sums(spark, sf):
    """Column sums of the coded survey, with an intercept and without."""
    parts = []
    for coding, intercept in (("intercept", True), ("no intercept", False)):
        d = _full_design(spark, sf, intercept)
        rows = d.rows().select("x", "slots", "y", F.lit(0).alias("fold"))
        blocks = RowBlocks(rows, len(d.names), d.dense)
        totals = blocks.sum(column_sums, len(d.names)).tolist()
        parts += [(coding, name, total) for name, total in zip(d.names, totals)]
    return _rounded(rows_to_df(spark, parts, "coding string, slot string, total double"), 4, "total")


def tree_stump_two(spark, sf):
    df = _survey(spark, sf).withColumn("third", (F.col("row_id") % 3).cast("int"))
    d = design(df, "preference", ["job_satisfaction", "tech_tools"])
    fit = tree_cv(d, "row_id", folds=3, depths=(1,), gains=(0.0,), fold_col="third")
    return _rounded(fit.results(spark), 6, "accuracy")


def wide_levels_path(spark, sf):
    """Finished orders by customer, priority and price: a factor with a level for each
    customer, of which the driver never sees the list."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        F.format_string("c%09d", "o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") / 1e5).alias("price"),
    )
    d = wide_design(orders, "finished", ["customer", "priority", "price"], intercept=False)
    return wide_path(d, 1.0, [0.005, 0.004], tol=1e-5).path(spark)


def _path_two(alpha: float, lambdas: list[float]) -> Query:
    def run(spark, sf):
        d = design(_survey(spark, sf), "preference", TWO, intercept=False)
        return _rounded(coef_path(d, "row_id", alpha, lambdas, tol=1e-9).path(spark), 4, "coefficient")

    return run


def _group_lasso(spark, sf):
    cols = [c for group in GROUPS.values() for c in group]
    return group_lasso_cv(assemble(_survey(spark, sf), "preference", cols), "row_id", GROUPS)


def group_lasso_path(spark, sf):
    return _group_lasso(spark, sf).path(spark)


def group_lasso_selected(spark, sf):
    path = _group_lasso(spark, sf)
    return selected_groups(spark, path, GROUPS, path.best)


def _fitted_models(spark, sf) -> DataFrame:
    """The stored table of nine models fitted on the training rows."""
    train, _ = train_test(_survey(spark, sf), "row_id", 0.2, seed=100)
    d = design(train, "preference", TERMS)
    bare = design(train, "preference", TERMS, intercept=False)
    cols = [c for group in GROUPS.values() for c in group]
    grouped = assemble(train, "preference", cols)

    full = glm.fit_logistic(d).coefficients(spark)
    coefs = {"full_logistic": (d, {r.term: r.estimate for r in full.collect()})}
    for way, chosen in stepwise_all(d).items():
        coefs[f"stepwise_{way}"] = (d, chosen.fit.named(d.names))
    kinds = {0.0: "ridge", 1.0: "lasso", 0.5: "elastic_net"}
    for alpha, path in penalized_cvs(bare, "row_id", list(kinds)).items():
        coefs[kinds[alpha]] = (bare, path.terms_at(path.best))
    group_path = group_lasso_cv(grouped, "row_id", GROUPS)
    coefs["group_lasso"] = (grouped, group_path.terms_at(group_path.best))
    rows = stored.tree_rows("decision_tree", d, tree_cv(d, "row_id").nodes)
    for model, (own, terms) in coefs.items():
        rows += stored.coefficient_rows(model, own, terms)
    return stored.model_table(spark, rows)


def stored_models(spark, sf) -> DataFrame:
    """The models as they were written: fitted once in a session for a folder of
    tables, read back by whoever scores with them."""
    made_by = f"{spark.sparkContext.applicationId}-{crc32(sf.encode()):08x}"
    path = f"{shared_folder(spark)}/models-{made_by}"
    known = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
        _fitted_models(spark, sf).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _fitted_scores(spark, sf) -> tuple[DataFrame, list[str]]:
    """Probabilities of the held-out rows that all stored models can score."""
    train, test = train_test(_survey(spark, sf), "row_id", 0.2, seed=100)
    table = stored_models(spark, sf)
    names = list(stored.stored_columns(table))
    factors = [c for c, kind in test.dtypes if c in TERMS and kind == "string"]
    seen = {f: train.select(f).distinct() for f in factors}
    for factor, levels in seen.items():
        test = test.join(levels, factor, "left_semi")
    known = stored.known_rows(test, table, {})
    y = F.col("preference").cast("double").alias("y")
    return stored.score_stored(known.withColumn("y", y), table, "row_id", "y"), names


def fitted_model_metrics(spark, sf):
    """Nine fitted models on held-out rows: mean probability and metrics."""
    scores, names = _fitted_scores(spark, sf)
    classes = scoring.classify_models(scores, names)
    return evaluation.metrics(evaluation.confusion(classes, names, "y")).join(
        evaluation.mean_probability(scores, names), "model"
    )


def fitted_last_ten(spark, sf):
    """Classes of the last ten held-out rows by each fitted model."""
    scores, names = _fitted_scores(spark, sf)
    return scoring.last_classes(scores, names, ["row_id"])


def fitted_best_recall(spark, sf):
    """The fitted model that finds most of the positive held-out rows."""
    scores, names = _fitted_scores(spark, sf)
    classes = scoring.classify_models(scores, names)
    found = evaluation.metrics(evaluation.confusion(classes, names, "y"))
    return evaluation.best_recall(found).select("model", "recall")


# --- contract ---------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Distinct ingested files per acquisition year."""
    return _layer_query("ingested", "year")(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    named = [
        acq_files_by_month, acq_files_by_year, ingested_files_both_grains, layer_coverage_by_year, layer_coverage_by_month,
        survey_recoded, contributions_from_csv, layer_list_by_year, contrib_org_rows, shared_not_linked_pairs, coef_sizes_two,
        factor_design_sums, tree_stump_two, group_lasso_cv_two, wide_levels_path,
        catalog_typed_inventory, ingested_feed_types, account_link_status, schema_has_tables,
        onboarding_type_labels, onboarding_status, onboarding_funnel, shared_not_linked,
        linked_by_type, contrib_by_code, contrib_org_columns, contrib_org_totals,
        contrib_by_contributor, contrib_individuals, contrib_individuals_anti,
        contrib_industry_share, contrib_size_bins, contrib_combined_share, contrib_stacked_share,
        contrib_city_totals, contrib_city_class, contrib_city_class_normalized,
        contrib_cohort_totals, pref_share_overall, pref_share_within, pref_subset_stats,
        pref_percent, satisfied_hours_mean_sd, train_test_split_sizes, train_test_repeated_ids, survey_row_numbers,
        score_given_model, mean_probability, classify_last_ten, classification_metrics,
        best_recall_model, glm_two_predictors, glm_two_designs, glm_deviance, glm_criteria,
        lrt_null_vs_two, glm_summary, glm_odds, glm_significant, step_both_significant, glm_odds_two, glm_significant_two, lasso_nonzero_two,
        lrt_full_vs_reduced,
        tree_accuracy, tree_document_quality, ridge_path, lasso_path, enet_path, lasso_cv,
        lasso_selected, coef_magnitudes, lasso_penalty_grid,
        group_lasso_path, group_lasso_selected, group_lasso_fixed_penalty, stored_models,
        fitted_model_metrics, fitted_last_ten, fitted_best_recall,
    ]
    out = {f.__name__: f for f in named}
    for layer in LAYERS:
        for grain in ("month", "year"):
            out[f"{layer}_files_by_{grain}"] = _layer_query(layer, grain)
    for kind, alpha, lam in (("ridge", 0.0, 0.1), ("lasso", 1.0, 0.02), ("enet", 0.5, 0.02)):
        out[f"{kind}_fixed_penalty"] = _fixed_penalty(alpha, lam)
    for kind, alpha, lams in (("ridge", 0.0, [0.1, 0.01]), ("lasso", 1.0, [0.05, 0.01]), ("enet", 0.5, [0.05, 0.01])):
        out[f"{kind}_cv_two"] = _cv_two(alpha, lams)
    out["ridge_path_two"] = _path_two(0.0, [0.1, 0.01])
    out["enet_path_two"] = _path_two(0.5, [0.05, 0.02])
    for direction in ("forward", "backward", "both"):
        out[f"step_{direction}"] = _step(direction)
        out[f"step_{direction}_two"] = _step_two(direction)
    return out | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE

    return ORACLE | LLM_ORACLE
