"""The six steps composed: profile, gaps, duplicates, variants, cleaning and the closing figures."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.values import MissingBands, ScoreBands
from ..operators import cleaning, duplicates, lens, profile, summary, variants
from ..operators.profile import ROW_ID
from ..operators.roles import DEFAULT_ROLES, Roles
from ..session import settle
from ..sources import sinks


@dataclass(frozen=True)
class Reports:
    """The stored outcome of the steps."""

    size: DataFrame
    missing: DataFrame
    duplicates: DataFrame
    variants: DataFrame
    mapping: DataFrame


def reports(
    table: DataFrame,
    name: str,
    *,
    row_id: str = ROW_ID,
    lexical: bool = False,
    roles: Roles = DEFAULT_ROLES,
    missing_bands: MissingBands = MissingBands(),
    score_bands: ScoreBands = ScoreBands(),
) -> Reports:
    """Run the reporting steps, each stored once because several figures read it."""
    found = settle(variants.variant_report(table, roles=roles, bands=score_bands))
    gaps = settle(profile.missing_values_report(table, row_id=row_id, lexical=lexical, bands=missing_bands))
    groups = settle(duplicates.duplicate_groups(table, row_id=row_id, roles=roles))
    return Reports(
        size=profile.table_facts(table, name, row_id=row_id),
        missing=gaps,
        duplicates=groups,
        variants=found,
        mapping=cleaning.cleaning_mapping(found),
    )


def final_report(table: DataFrame, name: str, **options) -> DataFrame:
    """Figures of the closing report."""
    done = reports(table, name, **options)
    return summary.final_facts(done.size, done.missing, done.duplicates, done.variants, done.mapping)


REPORT_NAMES = ("missing", "duplicates", "variants", "mapping")


def store_reports(done: Reports, folder: str, *, protected: Iterable[str], fmt: str = "csv") -> dict[str, str]:
    """Write each report to a folder of its own under ``folder``, for review; returns their paths."""
    sources = list(protected)
    return {
        name: sinks.write_table(getattr(done, name), f"{folder.rstrip('/')}/{name}", protected=sources, fmt=fmt) for name in REPORT_NAMES
    }


def clean(
    table: DataFrame, *, report: DataFrame | None = None, roles: Roles = DEFAULT_ROLES, bands: ScoreBands = ScoreBands()
) -> DataFrame:
    """Apply the accepted variants of the primary organization.

    They are detected, unless a variant report is given: one stored earlier, and perhaps edited by a
    reviewer (``tables.read_report`` with ``variants.VARIANT_SCHEMA``).
    """
    found = variants.variant_report(table, roles=roles, bands=bands) if report is None else report
    mapping = cleaning.cleaning_mapping(found)
    return cleaning.cleaned_table(table, mapping, roles)


def overview(
    table: DataFrame,
    name: str,
    chosen: lens.Lens = lens.Lens(),
    *,
    row_id: str = ROW_ID,
    roles: Roles = DEFAULT_ROLES,
    **options,
) -> dict[str, DataFrame]:
    """Everything the overview shows for one slice, as named tables."""
    done = reports(table, name, row_id=row_id, roles=roles, **options)
    # Ten outputs read the cleaned table and its slice, and six the facets.
    cleaned = settle(cleaning.cleaned_table(table, done.mapping, roles))
    # Without a lens the slice is the cleaned table, which is stored already.
    part = settle(lens.lens_filter(cleaned, chosen, roles)) if chosen.active else cleaned
    counted = settle(lens.facets(part, row_id=row_id, roles=roles))
    top = lens.leaders(part, counted=counted, records=part.count(), row_id=row_id, roles=roles)
    return {
        "headline": lens.headline_counts(done.size, cleaned, done.missing, done.duplicates, done.mapping, row_id),
        "insights": lens.insights(done.missing, done.duplicates, done.variants, top),
        "options": lens.filter_options(cleaned, row_id=row_id, roles=roles),
        "key_figures": lens.key_figures(part, roles),
        "owners": lens.label_chart(counted, lens.OWNER),
        "regions": lens.label_chart(counted, lens.REGION),
        "years": lens.year_chart(counted),
        "leaders": top,
        "share": lens.compare_to_whole(cleaned, chosen, roles),
        "preview": lens.preview(part, row_id=row_id, roles=roles),
        "preview_status": lens.preview_status(part),
        "missing_distribution": summary.distribution(
            summary.missing_summary(done.missing), "recommendation", "column_count"
        ),
        "duplicate_distribution": summary.distribution(
            summary.duplicate_summary(done.duplicates), "duplicate_type", "group_count"
        ),
        "variant_distribution": summary.distribution(summary.variant_summary(done.variants), "status", "pair_count"),
        "missing_bars": summary.bars(done.missing, "column_name", "missing_percentage"),
        "missing_table": summary.first_missing_columns(done.missing),
        "duplicate_table": summary.largest_duplicate_groups(done.duplicates),
        "accepted_variants": summary.top_variants(done.variants, "accepted"),
        "review_variants": summary.top_variants(done.variants, "review"),
    }
