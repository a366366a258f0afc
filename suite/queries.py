"""One registered query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.functions import scoring, text, values
from cleargrain.functions.text import normalize, quoted
from cleargrain.operators import cleaning, duplicates, lens, profile, roles, summary, variants
from cleargrain.plans import steps
from cleargrain.session import scratch_path
from cleargrain.sources import ranking, sinks, tables

from .agreements import agreements, agreements_with_copies, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORG = "recipient_legal_name"
TRADE = "recipient_operating_name"
GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
LENS = lens.Lens(search=" nation_1", region="qc", owner="", year="1998 ")


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def on_agreements(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a query that is a function of the agreements table."""

    def register(run: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: run(agreements(spark, sf_dir))
        return run

    return register


def on_cleaned(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a query that is a function of the cleaned agreements table."""

    def register(run: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: run(_cleaned(agreements(spark, sf_dir)))
        return run

    return register


def _col(df: DataFrame, name: str):
    return quoted(name), df.schema[name].dataType


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Money totals to the cent: the order of a distributed sum shows in later digits."""
    return df.withColumns({name: F.round(F.col(name), 2) for name in names})


def _counts(df: DataFrame, column: str = ORG) -> DataFrame:
    return variants.value_counts(df, column)


def _names(df: DataFrame, column: str = ORG) -> DataFrame:
    return variants.representatives(_counts(df, column))


def _members(df: DataFrame) -> DataFrame:
    return variants.block_members(_names(df))


def _mapping(df: DataFrame) -> DataFrame:
    return cleaning.cleaning_mapping(variants.variant_report(df))


def _cleaned(df: DataFrame) -> DataFrame:
    return cleaning.cleaned_table(df, _mapping(df))


def _missing(df: DataFrame) -> DataFrame:
    return profile.missing_values_report(df, lexical=True)


# Sources and sinks


@query("s1_table_source")
def _(spark, sf_dir):
    return tables.read_parquet(spark, f"{sf_dir}/orders.parquet", key="o_orderkey")


@query("s1_scan_order")
def _(spark, sf_dir):
    """Without a key; the file holds the orders by their key."""
    return tables.read_parquet(spark, f"{sf_dir}/orders.parquet")


@query("s2_rank_tables")
def _(spark, sf_dir):
    named = {f"{name} rev-{i % 3}": table(spark, sf_dir, name) for i, name in enumerate(GIVEN_TABLES)}
    return ranking.rank_tables(ranking.profile_tables(spark, named))


@query("s2_primary_table")
def _(spark, sf_dir):
    named = {f"{name} rev-{i % 3}": table(spark, sf_dir, name) for i, name in enumerate(GIVEN_TABLES)}
    return ranking.primary_table(ranking.rank_tables(ranking.profile_tables(spark, named)))


@on_agreements("s3_bounded_sample")
def _(df):
    return tables.head_rows(df, 5000)


@query("s4_stored_report")
def _(spark, sf_dir):
    report = variants.variant_report(agreements(spark, sf_dir))
    path = sinks.write_table(report, scratch_path(spark, "variants"), fmt="csv", protected=[sf_dir])
    return tables.read_report(spark, path, variants.VARIANT_SCHEMA)


@query("s4_edited_report")
def _(spark, sf_dir):
    """Store the reports, read the variants back, accept the better half of those in review, clean."""
    df = agreements(spark, sf_dir)
    paths = steps.store_reports(steps.reports(df, "agreements", lexical=True), scratch_path(spark, "reports"), protected=[sf_dir])
    report = tables.read_report(spark, paths["variants"], variants.VARIANT_SCHEMA)
    edited = report.withColumn("status", F.when(F.col("similarity_score") >= 90, "accepted").otherwise(F.col("status")))
    return steps.clean(df, report=edited)


@query("s5_csv_round_trip")
def _(spark, sf_dir):
    rows = agreements(spark, sf_dir).drop("_row_id", "foreign_currency_value")
    path = sinks.write_table(rows, scratch_path(spark, "agreements"), fmt="csv", protected=[sf_dir])
    return tables.read_csv(spark, path, key="#")


@query("s5_csv_odd_cells")
def _(spark, sf_dir):
    """Cells that a delimited file must quote or must not trim."""
    name, key = F.col("c_name"), F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(F.lit(" "), name, F.lit("  ")).alias("padded"),
        F.concat(name, F.lit("\nsecond line\n")).alias("lines"),
        F.concat(F.lit('say "'), name, F.lit('", twice')).alias("quoted"),
        F.concat(F.lit("\t"), name, F.lit("\\")).alias("tabbed"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "x").alias("sparse"),
    )
    path = sinks.write_table(rows, scratch_path(spark, "cells"), fmt="csv", protected=[sf_dir])
    return tables.read_csv(spark, path, key="id")


@query("s6_cleaned_round_trip")
def _(spark, sf_dir):
    cleaned = _cleaned(agreements(spark, sf_dir))
    path = sinks.write_table(cleaned, scratch_path(spark, "cleaned"), fmt="parquet", protected=[sf_dir])
    return tables.read_parquet(spark, path, key="#")


# Columns and expressions


@on_agreements("p1_value_type")
def _(df):
    names = [c for c in df.columns if c != "_row_id"]
    return df.select(
        "_row_id", *[values.value_type(*_col(df, c), lexical=True).alias(f"type_{i}") for i, c in enumerate(names)]
    )


@on_agreements("p1b_single_type")
def _(df):
    value = _col(df, "agreement_value")
    return df.select(
        "_row_id",
        values.is_type(*value, "text", lexical=True).alias("text_like"),
        values.is_type(*value, "numeric", lexical=True).alias("numeric_like"),
        values.is_type(*_col(df, "agreement_end_date"), "date").alias("date_like"),
    )


@on_agreements("p2_missing")
def _(df):
    names = ("agreement_number", "agreement_title_en", "foreign_currency_value", "agreement_end_date")
    return df.select("_row_id", *[text.is_missing(*_col(df, c)).alias(f"{c}_missing") for c in names])


@on_agreements("p3_normalize_names")
def _(df):
    return df.select(
        "_row_id",
        text.normalize(F.col(ORG)).alias("normalized"),
        text.normalize(F.col(ORG), uppercase=False).alias("kept_case"),
        text.normalize(F.col(ORG), remove_accents=False).alias("kept_accents"),
        text.normalize(F.col(ORG), remove_punctuation=False).alias("kept_punctuation"),
        text.normalize(F.col(ORG), collapse_whitespace=False).alias("kept_spaces"),
    )


@query("p3_normalize_documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents", key="doc_id").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query("p3_normalize_conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations", key="conv_id").select(
        "conv_id", "turn", text.normalize(F.col("text")).alias("normalized")
    )


@query("p4_strip_accents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents", key="doc_id").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@on_agreements("p5_normalized_companions")
def _(df):
    return text.with_normalized(df.select("_row_id", ORG, "agreement_title_fr"), ORG, "agreement_title_fr")


@on_agreements("p7_serialize")
def _(df):
    names = [c for c in df.columns if c != "_row_id"]
    return df.select("_row_id", *[text.serialize(*_col(df, c)).alias(f"key_{i}") for i, c in enumerate(names)])


@on_agreements("p8_missing_recommendation")
def _(df):
    """Bands of the percentage of gaps of every column."""
    found = profile.column_counts(df, lexical=True)
    share = values.percent(F.col("missing_count"), F.col("total_rows"))
    return found.select("column_name", values.missing_recommendation(share).alias("recommendation"))


@on_agreements("p9_score_status")
def _(df):
    """Bands of the score of every pair of names in a block that reaches the minimum."""
    return variants.scored_pairs(_names(df)).select("left_normalized_value", "right_normalized_value", values.score_status(F.col("score")).alias("status"))


@on_agreements("p10_duplicate_columns")
def _(df):
    return df.select("_row_id", *roles.duplicate_columns(df.columns))


@on_agreements("p11_organization_columns")
def _(df):
    return df.select("_row_id", *roles.organization_columns(df.columns))


@on_agreements("p12_primary_organization")
def _(df):
    return df.select("_row_id", quoted(roles.primary_organization(df.columns)).alias("organization"))


@on_agreements("p13_to_number")
def _(df):
    return df.select(
        "_row_id",
        values.to_number(F.col("agreement_value")).alias("value_number"),
        values.to_number(F.col("recipient_business_number")).alias("business_number"),
    )


@on_agreements("p14_start_year")
def _(df):
    return df.select(
        "_row_id",
        values.start_year(F.col("agreement_start_date")).alias("start_year"),
        values.start_year(F.col("agreement_title_fr")).alias("not_a_year"),
    )


@on_agreements("p15_contains")
def _(df):
    return df.select("_row_id", text.contains_ignoring_case(F.col(ORG), "nation-1").alias("found"))


@on_agreements("p16_equal_ignoring_case")
def _(df):
    return df.select(
        "_row_id", text.equals_ignoring_case(F.col("recipient_province_clean"), "hors du canada").alias("equal")
    )


@on_agreements("p17_clean_string")
def _(df):
    return df.select("_row_id", text.clean_string(F.concat(F.lit(" \t"), "agreement_number")).alias("cleaned"))


@on_cleaned("p18_preferred_recipient")
def _(df):
    return df.select("_row_id", lens.preferred_recipient().alias("recipient"))


@on_cleaned("p19_display_columns")
def _(df):
    return roles.display_columns(df)


@on_agreements("p20_known_region")
def _(df):
    return df.select("_row_id", values.is_known_region(F.col("recipient_province_clean")).alias("known"))


# Profiles


@on_agreements("a1_column_profile")
def _(df):
    return profile.column_profile(df, lexical=True)


@on_agreements("a2_inferred_type")
def _(df):
    return profile.column_counts(df, lexical=True).select("column_name", profile.inferred_type().alias("inferred_type"))


@on_agreements("a3_inferred_type_first_seen")
def _(df):
    return profile.column_counts(df, lexical=True).select(
        "column_name", profile.inferred_type(first_seen=True).alias("inferred_type")
    )


@on_agreements("a4_sample_values")
def _(df):
    return profile.first_values(df)


@on_agreements("a5_missing_values_report")
def _(df):
    return _missing(df)


@query("a5_missing_values_lineitem")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", key="l_orderkey").withColumn("_row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return profile.missing_values_report(lines)


@on_agreements("a6_top_missing")
def _(df):
    return profile.top_missing(_missing(df))


@on_agreements("a7_columns_by_type")
def _(df):
    return profile.columns_by_type(df, lexical=True)


@on_agreements("a8_table_facts")
def _(df):
    return profile.table_facts(df, "agreements")


@on_agreements("a9_removal_candidates")
def _(df):
    return profile.removal_candidates(_missing(df))


# Duplicates


@query("d1_exact_duplicates")
def _(spark, sf_dir):
    return duplicates.exact_duplicates(agreements_with_copies(spark, sf_dir))


@query("d1_exact_duplicate_texts")
def _(spark, sf_dir):
    texts = table(spark, sf_dir, "documents", key="doc_id").select(F.col("doc_id").alias("_row_id"), "text")
    return duplicates.exact_duplicates(texts)


@query("d1_exact_duplicates_direct")
def _(spark, sf_dir):
    return duplicates.exact_duplicates(agreements_with_copies(spark, sf_dir).repartition("ref_number"))


@query("d1_exact_full_keys")
def _(spark, sf_dir):
    return duplicates.exact_duplicates(agreements_with_copies(spark, sf_dir), full_key=True).select("full_key", "occurrences")


@on_agreements("d2_identifier_duplicates")
def _(df):
    return duplicates.identifier_duplicates(df)


@on_agreements("d3_probable_key")
def _(df):
    return duplicates.with_probable_key(df).select("_row_id", "probable_key")


@query("d4_probable_duplicates")
def _(spark, sf_dir):
    return duplicates.probable_duplicates(agreements_with_copies(spark, sf_dir))


@query("d5_first_example")
def _(spark, sf_dir):
    return duplicates.identifier_duplicates(agreements_with_copies(spark, sf_dir)).select(
        "rule_name", "duplicate_key", "example_ref_number", "example_organization"
    )


@query("d6_duplicate_groups")
def _(spark, sf_dir):
    return duplicates.duplicate_groups(agreements_with_copies(spark, sf_dir))


# Variants


@on_agreements("v1_value_counts")
def _(df):
    return _counts(df)


@on_agreements("v2_canonical_values")
def _(df):
    return variants.canonical_values(_counts(df))


@on_agreements("v3_exact_matches")
def _(df):
    return variants.exact_matches(_counts(df))


@on_agreements("v4_representatives")
def _(df):
    return variants.representatives(_counts(df))


@on_agreements("v5_block_keys")
def _(df):
    return _members(df)


@on_agreements("v7_candidate_pairs")
def _(df):
    return variants.candidate_pairs(_members(df))


@on_agreements("v8_scored_pairs")
def _(df):
    return variants.scored_pairs(_names(df)).select("left_normalized_value", "right_normalized_value", F.bround("score", 2).alias("score"))


@on_agreements("v8_scored_pairs_edit")
def _(df):
    return variants.scored_pairs(_names(df), metric="edit").select("left_normalized_value", "right_normalized_value", F.bround("score", 2).alias("score"))


@on_agreements("v9_directed_matches")
def _(df):
    return variants.fuzzy_matches(_counts(df))


@on_agreements("v10_strongest_matches")
def _(df):
    return variants.strongest_fuzzy_matches(_counts(df))


@on_agreements("v10_strongest_of_all")
def _(df):
    return variants.strongest_matches(variants.fuzzy_matches(_counts(df)))


@on_agreements("v10_two_forms")
def _(df):
    """A ready-made form that is not the same for all rows of a spelling."""
    forms = F.when(F.col("_row_id") % 5 == 0, F.concat(normalize(F.col(ORG)), F.lit(" CO"))).otherwise(normalize(F.col(ORG)))
    return variants.variant_report(df.withColumn("form", forms), ORG, normalized="form")


@on_agreements("v11_variant_report")
def _(df):
    return variants.variant_report(df)


@on_agreements("v11_variant_report_trade")
def _(df):
    return variants.variant_report(df, TRADE)


# Cleaning


@on_agreements("c1_cleaning_mapping")
def _(df):
    return _mapping(df)


@on_agreements("c2_accepted_mapping")
def _(df):
    return cleaning.accepted_mapping(_mapping(df))


@on_agreements("c3_normalized_organizations")
def _(df):
    return cleaning.with_normalized_organizations(df).select(
        "_row_id", *[f"{c}_normalized_codex" for c in roles.organization_columns(df.columns)]
    )


@on_agreements("c4_cleaned_table")
def _(df):
    return _cleaned(df)


@on_agreements("c4_cleaned_table_exchanged")
def _(df):
    return cleaning.cleaned_table(df, _mapping(df), broadcast_rows=0)


# Summaries


@on_agreements("g1_missing_summary")
def _(df):
    return summary.missing_summary(_missing(df))


@on_agreements("g2_duplicate_summary")
def _(df):
    return summary.duplicate_summary(duplicates.duplicate_groups(df))


@on_agreements("g3_variant_summary")
def _(df):
    return summary.variant_summary(variants.variant_report(df))


@on_agreements("g4_cleaning_summary")
def _(df):
    return summary.cleaning_summary(_mapping(df))


@on_agreements("g5_top_missing")
def _(df):
    return profile.top_missing(_missing(df))


@on_agreements("g5_top_duplicate_groups")
def _(df):
    return summary.top_duplicate_groups(duplicates.duplicate_groups(df))


@on_agreements("g5_top_variant_pairs")
def _(df):
    return summary.top_variant_pairs(variants.variant_report(df))


@on_agreements("g6_status_counts")
def _(df):
    return summary.status_counts(_mapping(df))


@on_agreements("g7_distribution")
def _(df):
    return summary.distribution(summary.missing_summary(_missing(df)), "recommendation", "column_count")


@on_agreements("g8_bars")
def _(df):
    return summary.bars(_missing(df), "column_name", "missing_percentage")


@on_agreements("g9_largest_duplicate_groups")
def _(df):
    return summary.largest_duplicate_groups(duplicates.duplicate_groups(df))


@on_agreements("g9_first_missing_columns")
def _(df):
    return summary.first_missing_columns(_missing(df))


@on_agreements("g10_accepted_variants")
def _(df):
    return summary.top_variants(variants.variant_report(df), "accepted")


@on_agreements("g10_review_variants")
def _(df):
    return summary.top_variants(variants.variant_report(df), "review")


@on_agreements("g11_accepted_ratio")
def _(df):
    return summary.accepted_ratio(variants.variant_report(df))


@query("g12_final_facts")
def _(spark, sf_dir):
    return steps.final_report(agreements_with_copies(spark, sf_dir), "agreements", lexical=True)


# Lens and search


@on_cleaned("l1_filter_options")
def _(df):
    return lens.filter_options(df)


@on_agreements("l2_lens_filter")
def _(df):
    return lens.cleaned_slice(df, _mapping(df), LENS)


@query("l2_lens_filter_clustered")
def _(spark, sf_dir):
    """The slice, read from a cleaned table that is stored by start date and region."""
    by = ["agreement_start_date", "recipient_province_clean"]
    path = sinks.write_table(_cleaned(agreements(spark, sf_dir)), scratch_path(spark, "clustered"), protected=[sf_dir], cluster_by=by)
    return lens.lens_filter(spark.read.parquet(path), LENS)


@on_cleaned("l3_key_figures")
def _(df):
    return _rounded(lens.key_figures(df), "total_value", "average_value")


@on_cleaned("l3_key_figures_lens")
def _(df):
    return _rounded(lens.key_figures(lens.lens_filter(df, LENS)), "total_value", "average_value")


@on_cleaned("l4_owner_chart")
def _(df):
    return lens.label_chart(lens.facets(df), lens.OWNER)


@on_cleaned("l4_region_chart")
def _(df):
    return lens.label_chart(lens.facets(df), lens.REGION)


@on_cleaned("l5_year_chart")
def _(df):
    return _rounded(lens.year_chart(lens.facets(df)), "total_value")


@on_cleaned("l5b_label_values")
def _(df):
    return _rounded(lens.label_values(lens.facets(df), lens.OWNER), "total_value")


@on_cleaned("l6_preview")
def _(df):
    return lens.preview(lens.lens_filter(df, LENS))


@on_cleaned("l6_preview_status")
def _(df):
    return lens.preview_status(lens.lens_filter(df, LENS))


@on_cleaned("l7_leaders")
def _(df):
    return _rounded(lens.leaders(lens.lens_filter(df, LENS)), "total_value")


@on_cleaned("l8_compare_to_whole")
def _(df):
    return _rounded(lens.compare_to_whole(df, LENS), "slice_value", "all_value")


@query("l9_insights")
def _(spark, sf_dir):
    return _rounded(steps.overview(agreements_with_copies(spark, sf_dir), "agreements", lexical=True)["insights"], "value")


@query("l10_headline_counts")
def _(spark, sf_dir):
    return steps.overview(agreements_with_copies(spark, sf_dir), "agreements", lexical=True)["headline"]


@on_cleaned("l11_search")
def _(df):
    return lens.search(df, "Nation_2 ", "recipient")


@on_cleaned("l11_search_agreement")
def _(df):
    return lens.search(df, "urgent", "agreement", limit=40)


@on_cleaned("l11_search_blank")
def _(df):
    return lens.search(df)


@on_cleaned("l11_search_status")
def _(df):
    return lens.search_status(lens.search(df, "Nation_2 ", "unknown scope"), "Nation_2 ")
