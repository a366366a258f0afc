"""Reference SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

import re

from .agreements import AGREEMENTS_SQL, COPY_OFFSET

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DISPLAY = (
    "ref_number, recipient_legal_name, recipient_legal_name_cleaned_codex, owner_org_title, agreement_title_en, "
    "agreement_value, agreement_start_date, agreement_end_date"
)
PREVIEW = (
    "ref_number, recipient_legal_name, recipient_legal_name_cleaned_codex, owner_org_title, recipient_province_clean, "
    "agreement_title_en, agreement_value, agreement_start_date"
)
KNOWN = "('AB','BC','MB','NB','NL','NS','NT','NU','ON','PE','QC','SK','YT','Hors du Canada')"
MISSING_BAND = (
    "CASE WHEN {0} <= 0 THEN 'Nothing' WHEN {0} < 5 THEN 'Simple Imputation' WHEN {0} <= 40 THEN 'Imputation + Missing Flag' "
    "WHEN {0} <= 70 THEN 'Evaluate Utility' ELSE 'Possible Removal' END"
)
STATUS = "CASE WHEN {0} >= 95 THEN 'accepted' WHEN {0} >= 80 THEN 'review' ELSE 'rejected' END"
RECOMMENDED = (
    "CASE duplicate_type WHEN 'exact_duplicate' THEN 'Confirm whether the repeated rows are redundant records.' "
    "WHEN 'identifier_duplicate' THEN 'Review whether repeated identifiers represent true duplicates or legitimate amendments.' "
    "ELSE 'Manual review required because similarity on business fields does not prove redundancy.' END AS review_recommendation"
)

# Columns of the agreements table with the kind of their values.
COLUMNS = {
    "#": "int", "ref_number": "text", "amendment_number": "int", "agreement_number": "text",
    "recipient_business_number": "text", "recipient_legal_name": "text", "recipient_operating_name": "text",
    "recipient_province_clean": "text", "agreement_title_en": "text", "agreement_title_fr": "text",
    "agreement_value": "text", "foreign_currency_value": "double", "agreement_start_date": "date",
    "agreement_end_date": "date", "coverage": "text", "owner_org": "text", "owner_org_title": "text",
}


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def unmarked(x: str) -> str:
    return f"replace(regexp_replace({x}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g'), chr(160), ' ')"


def norm(x: str, upper: bool = True, plain: bool = True) -> str:
    x = unmarked(x)
    x = f"strip_accents({x})" if plain else x
    # The full upper-case mapping of sharp s is SS; this engine's upper() maps single characters only.
    x = f"upper(replace({x}, 'ß', 'ss'))" if upper else x
    return f"nullif(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


def number(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({trim(x)}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN TRY_CAST({trim(x)} AS DOUBLE) END"
    )


def absent(name: str) -> str:
    col = f'"{name}"'
    return f"({col} IS NULL OR isnan({col}))" if COLUMNS[name] == "double" else f"({col} IS NULL)"


def shown(name: str, separator: str = " ") -> str:
    if COLUMNS[name] == "date":
        return f"strftime(\"{name}\", '%Y-%m-%d{separator}%H:%M:%S')"
    return f'CAST("{name}" AS VARCHAR)'


def key(name: str) -> str:
    return f"CASE WHEN {absent(name)} THEN '<MISSING>' ELSE {trim(shown(name, 'T'))} END"


def tag(name: str) -> str:
    kind = {"int": "'numeric'", "double": "'numeric'", "date": "'date'"}.get(COLUMNS[name])
    if kind is None:
        kind = (
            f"CASE WHEN lower({trim(name)}) IN ('true','false') THEN 'boolean' "
            f"WHEN regexp_full_match({trim(name)}, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?)?') "
            f"AND TRY_CAST({trim(name)} AS TIMESTAMP) IS NOT NULL THEN 'date' "
            f"WHEN regexp_full_match({trim(name)}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 'numeric' ELSE 'text' END"
        )
    return f"CASE WHEN {absent(name)} THEN 'missing' ELSE {kind} END"


def pct(part: str, whole: str) -> str:
    return f"coalesce(round_even(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100, 2), 0.0)"


def per_column(select: str, source: str = "agreements") -> str:
    return " UNION ALL ".join(
        "SELECT " + select.format(ordinal=i, name=name, tag=tag(name), absent=absent(name), shown=shown(name)) + f" FROM {source}"
        for i, name in enumerate(COLUMNS)
    )


PROBABLE = (
    "CASE WHEN {org} IS NOT NULL AND 1 + CAST({title} IS NOT NULL AS INTEGER) + "
    + " + ".join(f"CAST({key(c)} <> '<MISSING>' AS INTEGER)" for c in ("agreement_value", "agreement_start_date", "agreement_end_date", "owner_org"))
    + " >= 4 THEN {org} || ' | ' || coalesce({title}, '<MISSING>') || ' | ' || "
    + " || ' | ' || ".join(key(c) for c in ("agreement_value", "agreement_start_date", "agreement_end_date", "owner_org"))
    + " END"
).format(
    org=norm("recipient_legal_name"),
    title=norm("coalesce(nullif(agreement_title_en, ''), agreement_title_fr)"),
)

KEYS = [c for c in COLUMNS if c != "#"]
LENS = (
    "(" + " OR ".join(
        f"contains(upper(coalesce({c}, '')), 'NATION_1')"
        for c in ("ref_number", "recipient_legal_name", "recipient_legal_name_cleaned_codex", "owner_org_title", "agreement_title_en")
    ) + ") AND lower(upper(recipient_province_clean)) = 'qc' AND left(CAST(agreement_start_date AS VARCHAR), 4) = '1998'"
)


def identifier_groups(source: str) -> str:
    rules = {c: f"CASE WHEN {absent(c)} THEN NULL ELSE {key(c)} END" for c in ("ref_number", "agreement_number", "recipient_business_number")}
    return keyed_groups(source, "identifier_duplicate", rules)


def keyed_groups(source: str, kind: str, rules: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_name, {expr} AS duplicate_key, _row_id, {key('ref_number')} AS r, {key('recipient_legal_name')} AS o FROM {source}"
        for rule, expr in rules.items()
    )
    return f"""SELECT *, {RECOMMENDED} FROM (
      SELECT '{kind}' AS duplicate_type, rule_name, duplicate_key, count(*) AS occurrences,
        arg_min(r, _row_id) AS example_ref_number, arg_min(o, _row_id) AS example_organization
      FROM ({rows}) WHERE duplicate_key IS NOT NULL GROUP BY rule_name, duplicate_key HAVING count(*) > 1)"""


def probable_groups(source: str) -> str:
    return keyed_groups(source, "probable_duplicate", {"organization_title_value_date_owner": PROBABLE})


def exact_groups(source: str) -> str:
    parts = ", ".join(f"{key(c)} AS k{i}" for i, c in enumerate(KEYS))
    names = ", ".join(f"k{i}" for i in range(len(KEYS)))
    return f"""SELECT *, {RECOMMENDED} FROM (
      SELECT 'exact_duplicate' AS duplicate_type, 'all_columns_except_row_number' AS rule_name,
        {" || ' || ' || ".join(f"k{i}" for i in range(8))} AS duplicate_key, count(*) AS occurrences,
        k{KEYS.index("ref_number")} AS example_ref_number, k{KEYS.index("recipient_legal_name")} AS example_organization
      FROM (SELECT {parts} FROM {source}) GROUP BY {names} HAVING count(*) > 1)"""


def value_counts(column: str, form: str | None = None) -> str:
    if form:
        return f"""SELECT original_value, normalized_value, count(*) AS frequency FROM (
          SELECT {trim(column)} AS original_value, {form} AS normalized_value FROM agreements)
          WHERE original_value <> '' AND normalized_value <> '' GROUP BY 1, 2"""
    return f"""SELECT original_value, {norm("original_value")} AS normalized_value, frequency FROM (
      SELECT {trim(column)} AS original_value, count(*) AS frequency FROM agreements
      WHERE {trim(column)} <> '' GROUP BY 1) WHERE {norm("original_value")} IS NOT NULL"""


def indel(a: str, b: str) -> str:
    """Insertions plus deletions, by a bit-parallel longest common subsequence over 127 bits."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = (
        f"CAST(list_sum(list_transform(range(length({a})), "
        f"lambda i: CASE WHEN substring({a}, CAST(i + 1 AS BIGINT), 1) = ch THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT)"
    )
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    left = f"list_reduce(list_concat([{full}], {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN length({a}) + length({b}) ELSE length({b}) - length({a}) + 2 * bit_count({left}) END"


def best_of(rows: str, by: str, order: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {rows}) WHERE rn = 1"


def fuzzy_chain(prefix: str, column: str, form: str | None = None) -> dict[str, str]:
    """Counting, blocking, scoring and choosing for one organization column."""
    p = prefix
    bucket = "CAST(length(replace(normalized_value, ' ', '')) // 5 AS VARCHAR)"
    return {
        f"{p}counts": value_counts(column, form),
        f"{p}canon": f"""SELECT normalized_value, original_value AS canonical_value, frequency AS canonical_count, spellings FROM (
          SELECT *, count(*) OVER (PARTITION BY normalized_value) AS spellings, row_number() OVER (
            PARTITION BY normalized_value ORDER BY frequency DESC, length(original_value) DESC, original_value DESC) AS rn
          FROM {p}counts) WHERE rn = 1""",
        f"{p}exact": f"""SELECT original_value AS variant_value, canonical_value, c.normalized_value AS normalized_variant,
          c.normalized_value AS normalized_canonical, frequency AS variant_count, canonical_count,
          CAST(100 AS DOUBLE) AS similarity_score, 'accepted' AS status, 'exact_normalized_match' AS match_basis,
          'Values become identical after deterministic text normalization.' AS justification
          FROM {p}counts c JOIN {p}canon k ON c.normalized_value = k.normalized_value WHERE original_value <> canonical_value""",
        f"{p}reps": f"SELECT normalized_value, canonical_value AS original_value, canonical_count AS frequency FROM {p}canon",
        f"{p}members": f"""SELECT *, unnest([
          'prefix:' || left(replace(normalized_value, ' ', ''), 6) || ':' || {bucket},
          'token:' || left(split_part(normalized_value, ' ', 1), 8) || ':' || {bucket},
          'initials:' || array_to_string(list_transform(string_split(normalized_value, ' ')[1:4], lambda w: left(w, 1)), '') || ':' || {bucket}
          ]) AS block FROM {p}reps""",
        f"{p}pairs": f"""SELECT DISTINCT l.normalized_value AS left_value, r.normalized_value AS right_value
          FROM {p}members l JOIN {p}members r ON l.block = r.block AND l.normalized_value < r.normalized_value""",
        f"{p}words": f"""SELECT *, list_sort(string_split(left_value, ' ')) AS lw, list_sort(string_split(right_value, ' ')) AS rw,
          list_intersect(list_distinct(string_split(left_value, ' ')), list_distinct(string_split(right_value, ' '))) AS both_w
          FROM {p}pairs""",
        f"{p}forms": f"""SELECT *, array_to_string(list_sort(list_filter(list_distinct(lw), lambda w: NOT list_contains(both_w, w))), ' ') AS lo,
          array_to_string(list_sort(list_filter(list_distinct(rw), lambda w: NOT list_contains(both_w, w))), ' ') AS ro,
          array_to_string(lw, ' ') AS ls, array_to_string(rw, ' ') AS rs,
          length(array_to_string(both_w, ' ')) AS common, CAST(length(array_to_string(both_w, ' ')) > 0 AS INTEGER) AS gap FROM {p}words""",
        f"{p}distances": f"""SELECT *, {indel("left_value", "right_value")} AS d_plain, {indel("ls", "rs")} AS d_sorted, {indel("lo", "ro")} AS d_only
          FROM {p}forms""",
        f"{p}scores": f"""SELECT left_value, right_value, greatest(
            (1.0::DOUBLE - d_plain / (length(left_value) + length(right_value))) * 100,
            0.95::DOUBLE * CASE WHEN common > 0 AND (lo = '' OR ro = '') THEN 100 ELSE greatest(
              (1.0::DOUBLE - d_sorted / (length(ls) + length(rs))) * 100,
              100 - 100 * d_only / (2 * (common + gap) + length(lo) + length(ro)),
              CASE WHEN common > 0 THEN 100 - 100 * (gap + length(lo)) / (2 * common + gap + length(lo)) END,
              CASE WHEN common > 0 THEN 100 - 100 * (gap + length(ro)) / (2 * common + gap + length(ro)) END) END) AS score
          FROM {p}distances""",
        f"{p}scored": f"SELECT * FROM {p}scores WHERE score >= 80",
        f"{p}fuzzy": f"""SELECT CASE WHEN w THEN ro ELSE lo END AS variant_value, CASE WHEN w THEN lo ELSE ro END AS canonical_value,
          CASE WHEN w THEN right_value ELSE left_value END AS normalized_variant,
          CASE WHEN w THEN left_value ELSE right_value END AS normalized_canonical,
          CASE WHEN w THEN rf ELSE lf END AS variant_count, CASE WHEN w THEN lf ELSE rf END AS canonical_count,
          round_even(score, 2) AS similarity_score, {STATUS.format("score")} AS status, 'fuzzy_blocked_match' AS match_basis,
          'RapidFuzz WRatio on normalized organization names within the same block.' AS justification
          FROM (SELECT s.*, l.original_value AS lo, r.original_value AS ro, l.frequency AS lf, r.frequency AS rf,
            (l.frequency, length(l.original_value), l.original_value) > (r.frequency, length(r.original_value), r.original_value) AS w
            FROM {p}scored s JOIN {p}reps l ON l.normalized_value = left_value JOIN {p}reps r ON r.normalized_value = right_value
            WHERE l.original_value <> r.original_value)""",
        f"{p}best": best_of(f"{p}fuzzy", "variant_value", "similarity_score DESC, canonical_count DESC, canonical_value"),
        f"{p}variants": f"""SELECT '{column}' AS source_column, * FROM
          (SELECT * FROM {p}exact UNION ALL BY NAME SELECT * FROM {p}best)""",
    }


CTES: dict[str, str] = {
    "agreements": AGREEMENTS_SQL,
    "copies": f"SELECT * FROM agreements UNION ALL SELECT * REPLACE (_row_id + {COPY_OFFSET} AS _row_id) FROM agreements WHERE _row_id % 40 = 0",
    "tags": per_column("_row_id, {ordinal} AS ordinal, '{name}' AS column_name, {tag} AS tag"),
    "copy_tags": per_column("_row_id, {ordinal} AS ordinal, '{name}' AS column_name, {tag} AS tag", "copies"),
    **{
        f"{p}type_counts": f"""SELECT ordinal, column_name, tag, count(*) AS n, min(_row_id) AS first_row,
          CASE tag WHEN 'date' THEN 0 WHEN 'numeric' THEN 1 WHEN 'text' THEN 2 WHEN 'boolean' THEN 3 ELSE 4 END AS rank
          FROM {p}tags WHERE tag <> 'missing' GROUP BY ALL"""
        for p in ("", "copy_")
    },
    **{
        f"{p}column_counts": f"""SELECT ordinal, column_name, count(*) AS total_rows,
          count(*) FILTER (WHERE tag = 'missing') AS missing_count FROM {p}tags GROUP BY ALL"""
        for p in ("", "copy_")
    },
    "typed_by_rank": best_of("type_counts", "ordinal", "n DESC, rank"),
    **{f"{p}typed_by_first": best_of(f"{p}type_counts", "ordinal", "n DESC, first_row") for p in ("", "copy_")},
    "displays": per_column("_row_id, {ordinal} AS ordinal, CASE WHEN {absent} THEN NULL ELSE {shown} END AS value"),
    "samples": """SELECT ordinal, string_agg(value, ', ' ORDER BY _row_id) AS sample_values FROM (
      SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY _row_id) AS rn FROM displays WHERE value IS NOT NULL)
      WHERE rn <= 3 GROUP BY ordinal""",
    **{
        f"{p}missing": f"""SELECT column_name, inferred_type, total_rows, missing_count, missing_percentage,
          {MISSING_BAND.format("missing_percentage")} AS recommendation FROM (
          SELECT c.column_name, coalesce(t.tag, 'unknown') AS inferred_type, total_rows, missing_count,
            {pct("missing_count", "total_rows")} AS missing_percentage
          FROM {p}column_counts c LEFT JOIN {p}typed_by_first t ON c.ordinal = t.ordinal)"""
        for p in ("", "copy_")
    },
    **{f"{p}ids": identifier_groups(s) for p, s in (("", "agreements"), ("copy_", "copies"))},
    **{f"{p}probables": probable_groups(s) for p, s in (("", "agreements"), ("copy_", "copies"))},
    **{f"{p}exacts": exact_groups(s) for p, s in (("", "agreements"), ("copy_", "copies"))},
    **{
        f"{p}dups": f"SELECT * FROM {p}exacts UNION ALL BY NAME SELECT * FROM {p}ids UNION ALL BY NAME SELECT * FROM {p}probables"
        for p in ("", "copy_")
    },
    **fuzzy_chain("", "recipient_legal_name"),
    **fuzzy_chain("trade_", "recipient_operating_name"),
    **fuzzy_chain(
        "form_", "recipient_legal_name", f"{norm('recipient_legal_name')} || CASE WHEN _row_id % 5 = 0 THEN ' CO' ELSE '' END"
    ),
    "mapping": """SELECT variant_value AS original_value, canonical_value AS cleaned_value, status,
      match_basis || ' with similarity score ' || CAST(similarity_score AS VARCHAR) || '. ' ||
      CASE WHEN status = 'accepted' THEN 'Automatic correction permitted.' ELSE 'Manual review required before correction.' END AS justification,
      similarity_score, source_column FROM variants""",
    "accepted": "SELECT original_value, cleaned_value FROM mapping WHERE status = 'accepted'",
    "cleaned": f"""SELECT a.*, {norm("recipient_legal_name")} AS recipient_legal_name_normalized_codex,
      {norm("recipient_operating_name")} AS recipient_operating_name_normalized_codex,
      {norm("owner_org_title")} AS owner_org_title_normalized_codex,
      coalesce(cleaned_value, recipient_legal_name) AS recipient_legal_name_cleaned_codex
      FROM agreements a LEFT JOIN accepted m ON {trim("recipient_legal_name")} = m.original_value""",
    "edited_accepted": "SELECT original_value, cleaned_value FROM mapping WHERE status = 'accepted' OR similarity_score >= 90",
    "edited_cleaned": f"""SELECT a.*, {norm("recipient_legal_name")} AS recipient_legal_name_normalized_codex,
      {norm("recipient_operating_name")} AS recipient_operating_name_normalized_codex,
      {norm("owner_org_title")} AS owner_org_title_normalized_codex,
      coalesce(cleaned_value, recipient_legal_name) AS recipient_legal_name_cleaned_codex
      FROM agreements a LEFT JOIN edited_accepted m ON {trim("recipient_legal_name")} = m.original_value""",
    "slice": f"SELECT * FROM cleaned WHERE {LENS}",
    **{
        f"{p}facets": f"""SELECT facet, label, count(*) AS records, sum(amount) AS total_value, min(_row_id) AS first_row FROM (
          SELECT _row_id, coalesce({number("agreement_value")}, 0) AS amount, unnest([
            {{'facet': 'owner', 'label': {trim("owner_org_title")}}},
            {{'facet': 'region', 'label': {trim("recipient_province_clean")}}},
            {{'facet': 'year', 'label': left(CAST(agreement_start_date AS VARCHAR), 4)}}], recursive := true)
          FROM {source}) WHERE label <> '' GROUP BY facet, label"""
        for p, source in (("", "cleaned"), ("slice_", "slice"))
    },
}


def sql(final: str) -> str:
    """A statement with just the expressions it needs."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    heads = ", ".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {heads} {final}" if heads else final


def facts(section: str, source: str, label: str, value: str) -> str:
    return f"SELECT '{section}' AS section, {label} AS label, CAST({value} AS DOUBLE) AS value FROM ({source})"


GIVEN = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
RANKED = "SELECT * EXCLUDE (headers) FROM (" + (
    "SELECT *, row_count > 0 AND non_empty_headers >= greatest(5, column_count // 2) AND score >= greatest(4, column_count // 5) AS is_candidate FROM ("
    "SELECT *, len(headers) AS column_count, len(headers) AS non_empty_headers, "
    "len(list_filter(headers, lambda h: regexp_matches(h, 'recipient|agreement|ref|owner_org|province|city|name|number|date|value'))) AS score, "
    "coalesce(TRY_CAST(regexp_extract(table_name, 'rev-(\\d+)', 1) AS INTEGER), -1) AS revision FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{name} rev-{i % 3}' AS table_name, count(*) AS row_count, {columns!r} AS headers FROM {name}"
        for i, (name, columns) in enumerate(GIVEN.items())
    )
    + ")))"
)
LINE_COLUMNS = {
    **{c: "numeric" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date",
}

MATCH_COLUMNS = (
    "variant_value, canonical_value, normalized_variant, normalized_canonical, variant_count, canonical_count, "
    "similarity_score, status, match_basis, justification"
)
REPORT_ORDER = "status, similarity_score DESC, canonical_count DESC, variant_count DESC, variant_value"
DUPLICATE_ORDER = "duplicate_type, occurrences DESC, rule_name, duplicate_key"
MISSING_ORDER = "missing_percentage DESC, column_name"
LABEL_ORDER = "records DESC, first_row"
HIT = "contains(upper(coalesce({0}, '')), '{1}')"


def label_chart(facet: str) -> str:
    return f"""SELECT label, records AS value, {pct("records", "total")} AS share FROM (
      SELECT *, sum(records) OVER () AS total FROM facets WHERE facet = '{facet}') ORDER BY {LABEL_ORDER} LIMIT 8"""


def key_figures(source: str) -> str:
    owner = f"nullif({trim('owner_org_title')}, '')"
    recipient = (
        f"coalesce(nullif({trim('recipient_legal_name_cleaned_codex')}, ''), nullif({trim('recipient_legal_name')}, ''))"
    )
    return f"""SELECT count(*) AS record_count, round(coalesce(sum(v), 0), 2) AS total_value,
      round(coalesce(avg(v), 0), 2) AS average_value, count(DISTINCT recipient) AS unique_recipients, count(DISTINCT owner) AS unique_owners
      FROM (SELECT {number("agreement_value")} AS v, {recipient} AS recipient, {owner} AS owner FROM {source})"""


def final_facts() -> str:
    parts = [
        facts("dataset", "SELECT count(*) AS n FROM copies", "'row_count'", "n"),
        facts("dataset", f"SELECT {len(COLUMNS)} AS n", "'column_count'", "n"),
        facts("missing_summary", "SELECT recommendation, count(*) AS n FROM copy_missing GROUP BY 1", "recommendation", "n"),
        facts("duplicate_summary", "SELECT duplicate_type, count(*) AS n FROM copy_dups GROUP BY 1", "duplicate_type", "n"),
        facts("variant_summary", "SELECT status, count(*) AS n FROM variants GROUP BY 1", "status", "n"),
        facts("cleaning_summary", "SELECT status, count(*) AS n FROM mapping GROUP BY 1", "status", "n"),
        facts("top_missing", f"SELECT * FROM copy_missing ORDER BY {MISSING_ORDER} LIMIT 10", "column_name", "missing_percentage"),
        facts("top_duplicates", f"SELECT * FROM copy_dups ORDER BY {DUPLICATE_ORDER} LIMIT 10", "duplicate_key", "occurrences"),
        facts("top_variants", f"SELECT * FROM variants ORDER BY {REPORT_ORDER} LIMIT 10", "variant_value", "similarity_score"),
        facts("corrections", "SELECT count(*) FILTER (WHERE status = 'accepted') AS n FROM mapping", "'accepted_count'", "n"),
        facts("corrections", "SELECT count(*) FILTER (WHERE status = 'review') AS n FROM mapping", "'review_count'", "n"),
    ]
    return over_copies(" UNION ALL ".join(parts))


def headline() -> str:
    parts = [
        facts("headline", "SELECT count(*) AS n FROM copies", "'row_count'", "n"),
        facts("headline", f"SELECT {len(COLUMNS)} AS n", "'column_count'", "n"),
        facts("headline", "SELECT count(*) FILTER (WHERE status = 'accepted') AS n FROM mapping", "'accepted_count'", "n"),
        facts("headline", "SELECT count(*) FILTER (WHERE status = 'review') AS n FROM mapping", "'review_count'", "n"),
        facts("headline", "SELECT count(*) AS n FROM copy_dups", "'duplicate_groups'", "n"),
        facts("headline", "SELECT count(*) FILTER (WHERE recommendation = 'Possible Removal') AS n FROM copy_missing", "'high_missing_columns'", "n"),
        facts("headline", f"SELECT {len(COLUMNS) + 4} AS n", "'cleaned_columns'", "n"),
    ]
    return over_copies(" UNION ALL ".join(parts))


def insights() -> str:
    year = f"SELECT * FROM facets WHERE facet = 'year' ORDER BY {LABEL_ORDER} LIMIT 1"
    parts = [
        facts("highest_missing", f"SELECT * FROM copy_missing ORDER BY {MISSING_ORDER} LIMIT 1", "column_name", "missing_percentage"),
        facts("largest_duplicate", "SELECT * FROM copy_dups ORDER BY occurrences DESC, duplicate_type, rule_name, duplicate_key LIMIT 1", "duplicate_key", "occurrences"),
        facts("mapping_rate", "SELECT round_even(avg(CAST(status = 'accepted' AS INTEGER)) * 100, 2) AS n FROM variants", "'accepted_ratio'", "n"),
        facts("strongest_year", year, "label", "records"),
        facts("strongest_year_value", year, "label", "round(total_value, 2)"),
    ]
    return over_copies(" UNION ALL ".join(parts))


def over_copies(final: str) -> str:
    """Let the variant and lens expressions read the table with copies."""
    text = sql(final)
    for name in ("counts", "cleaned"):
        body = CTES[name]
        text = text.replace(f"{name} AS ({body})", f"{name} AS ({body.replace('FROM agreements', 'FROM copies')})")
    # The substituted bodies may precede the table they now read.
    copies = f"copies AS ({CTES['copies']})"
    agreements = f"agreements AS ({CTES['agreements']})"
    if copies in text:
        text = text.replace(f", {copies}", "").replace(f"{agreements}", f"{agreements}, {copies}", 1)
    else:
        text = text.replace(agreements, f"{agreements}, {copies}", 1)
    return text


FINALS: dict[str, str] = {
    "s1_table_source": "SELECT *, o_orderkey AS _row_id FROM orders",
    "s1_scan_order": "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders",
    "s2_rank_tables": RANKED,
    "s2_primary_table": f"{RANKED} ORDER BY is_candidate DESC, score DESC, revision DESC, row_count DESC, column_count DESC, position LIMIT 1",
    "s3_bounded_sample": "SELECT * FROM agreements ORDER BY _row_id LIMIT 5000",
    "s4_stored_report": "SELECT * FROM variants",
    "s4_edited_report": "SELECT * FROM edited_cleaned",
    "s5_csv_round_trip": 'SELECT _row_id, CAST("#" AS VARCHAR) AS "#", '
    + ", ".join(
        f"strftime({c}, '%Y-%m-%dT%H:%M:%S.000') AS {c}" if kind == "date" else f"CAST({c} AS VARCHAR) AS {c}"
        for c, kind in COLUMNS.items()
        if c not in ("#", "foreign_currency_value")
    )
    + " FROM agreements",
    "s5_csv_odd_cells": """SELECT c_custkey AS _row_id, CAST(c_custkey AS VARCHAR) AS id, ' ' || c_name || '  ' AS padded,
      c_name || chr(10) || 'second line' || chr(10) AS lines, 'say "' || c_name || '", twice' AS quoted,
      chr(9) || c_name || chr(92) AS tabbed,
      CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' END AS sparse FROM customer""",
    "s6_cleaned_round_trip": "SELECT * FROM cleaned",
    "p1_value_type": "SELECT _row_id, " + ", ".join(f"{tag(c)} AS type_{i}" for i, c in enumerate(COLUMNS)) + " FROM agreements",
    "p1b_single_type": f"""SELECT _row_id, ({tag("agreement_value")}) = 'text' AS text_like,
      ({tag("agreement_value")}) = 'numeric' AS numeric_like, ({tag("agreement_end_date")}) = 'date' AS date_like FROM agreements""",
    "p2_missing": "SELECT _row_id, "
    + ", ".join(
        f"{absent(c)} AS {c}_missing"
        for c in ("agreement_number", "agreement_title_en", "foreign_currency_value", "agreement_end_date")
    )
    + " FROM agreements",
    "p3_normalize_names": f"""SELECT _row_id, {norm("recipient_legal_name")} AS normalized,
      {norm("recipient_legal_name", upper=False)} AS kept_case, {norm("recipient_legal_name", plain=False)} AS kept_accents,
      nullif(trim(regexp_replace(upper(strip_accents({unmarked("recipient_legal_name")})), '\\s+', ' ', 'g')), '') AS kept_punctuation,
      nullif(regexp_replace(upper(strip_accents({trim(unmarked("recipient_legal_name"))})), '[^\\p{{L}}\\p{{N}}_\\s]|_+', ' ', 'g'), '') AS kept_spaces
      FROM agreements""",
    "p3_normalize_documents": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "p3_normalize_conversations": f"SELECT conv_id, turn, {norm('text')} AS normalized FROM conversations",
    "p4_strip_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "p5_normalized_companions": f"""SELECT _row_id, recipient_legal_name, agreement_title_fr,
      {norm("recipient_legal_name")} AS recipient_legal_name_normalized_codex,
      {norm("agreement_title_fr")} AS agreement_title_fr_normalized_codex FROM agreements""",
    "p7_serialize": "SELECT _row_id, " + ", ".join(f"{key(c)} AS key_{i}" for i, c in enumerate(COLUMNS)) + " FROM agreements",
    "p8_missing_recommendation": "SELECT column_name, recommendation FROM missing",
    "p9_score_status": f"""SELECT left_value AS left_normalized_value, right_value AS right_normalized_value,
      {STATUS.format("score")} AS status FROM scored""",
    "p10_duplicate_columns": """SELECT _row_id, ref_number, agreement_number, recipient_business_number, recipient_legal_name,
      recipient_operating_name, agreement_title_en, agreement_title_fr, agreement_value, agreement_start_date,
      agreement_end_date, owner_org FROM agreements""",
    "p11_organization_columns": "SELECT _row_id, recipient_legal_name, recipient_operating_name, owner_org_title FROM agreements",
    "p12_primary_organization": "SELECT _row_id, recipient_legal_name AS organization FROM agreements",
    "p13_to_number": f"""SELECT _row_id, {number("agreement_value")} AS value_number,
      {number("recipient_business_number")} AS business_number FROM agreements""",
    "p14_start_year": """SELECT _row_id, left(CAST(agreement_start_date AS VARCHAR), 4) AS start_year,
      CASE WHEN regexp_full_match(left(agreement_title_fr, 4), '[0-9]{4}') THEN left(agreement_title_fr, 4) END AS not_a_year FROM agreements""",
    "p15_contains": "SELECT _row_id, contains(upper(recipient_legal_name), 'NATION-1') AS found FROM agreements",
    "p16_equal_ignoring_case": "SELECT _row_id, lower(recipient_province_clean) = 'hors du canada' AS equal FROM agreements",
    "p17_clean_string": f"SELECT _row_id, coalesce({trim('agreement_number')}, '') AS cleaned FROM agreements",
    "p18_preferred_recipient": f"""SELECT _row_id, coalesce(nullif({trim("recipient_legal_name_cleaned_codex")}, ''),
      nullif({trim("recipient_legal_name")}, '')) AS recipient FROM cleaned""",
    "p19_display_columns": f"SELECT {DISPLAY} FROM cleaned",
    "p20_known_region": f"SELECT _row_id, recipient_province_clean IN {KNOWN} AS known FROM agreements",
    "a1_column_profile": f"""SELECT c.column_name, coalesce(t.tag, 'unknown') AS inferred_type,
      total_rows - missing_count AS non_null_count, missing_count, {pct("missing_count", "total_rows")} AS missing_percentage,
      coalesce(sample_values, '') AS sample_values
      FROM column_counts c LEFT JOIN typed_by_rank t ON c.ordinal = t.ordinal LEFT JOIN samples s ON c.ordinal = s.ordinal""",
    "a2_inferred_type": """SELECT c.column_name, coalesce(t.tag, 'unknown') AS inferred_type
      FROM column_counts c LEFT JOIN typed_by_rank t ON c.ordinal = t.ordinal""",
    "a3_inferred_type_first_seen": """SELECT c.column_name, coalesce(t.tag, 'unknown') AS inferred_type
      FROM column_counts c LEFT JOIN typed_by_first t ON c.ordinal = t.ordinal""",
    "a4_sample_values": "SELECT * FROM samples",
    "a5_missing_values_report": "SELECT * FROM missing",
    "a5_missing_values_lineitem": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS inferred_type, count(*) AS total_rows,
        count(*) - count({c}) AS missing_count, 0.0::DOUBLE AS missing_percentage, 'Nothing' AS recommendation FROM lineitem"""
        for c, kind in LINE_COLUMNS.items()
    ),
    "a6_top_missing": f"SELECT * FROM missing ORDER BY {MISSING_ORDER} LIMIT 10",
    "a7_columns_by_type": """SELECT coalesce(t.tag, 'unknown') AS inferred_type, count(*) AS column_count,
      string_agg(c.column_name, ', ' ORDER BY c.ordinal) AS column_names
      FROM column_counts c LEFT JOIN typed_by_rank t ON c.ordinal = t.ordinal GROUP BY 1""",
    "a8_table_facts": f"SELECT 'agreements' AS table_name, count(*) AS row_count, {len(COLUMNS)} AS column_count FROM agreements",
    "a9_removal_candidates": "SELECT * FROM missing WHERE recommendation = 'Possible Removal'",
    "d1_exact_duplicates": "SELECT * FROM copy_exacts",
    "d1_exact_duplicates_direct": "SELECT * FROM copy_exacts",
    "d1_exact_full_keys": f"""SELECT md5({" || ' || ' || ".join(f"k{i}" for i in range(len(KEYS)))}) AS full_key, count(*) AS occurrences
      FROM (SELECT {", ".join(f"{key(c)} AS k{i}" for i, c in enumerate(KEYS))} FROM copies) GROUP BY ALL
      HAVING count(*) > 1""",
    "d1_exact_duplicate_texts": f"""SELECT *, {RECOMMENDED} FROM (SELECT 'exact_duplicate' AS duplicate_type,
      'all_columns_except_row_number' AS rule_name, duplicate_key, count(*) AS occurrences,
      '<MISSING>' AS example_ref_number, '<MISSING>' AS example_organization
      FROM (SELECT {trim("text")} AS duplicate_key FROM documents) GROUP BY duplicate_key HAVING count(*) > 1)""",
    "d2_identifier_duplicates": "SELECT * FROM ids",
    "d3_probable_key": f"SELECT _row_id, {PROBABLE} AS probable_key FROM agreements",
    "d4_probable_duplicates": "SELECT * FROM copy_probables",
    "d5_first_example": "SELECT rule_name, duplicate_key, example_ref_number, example_organization FROM copy_ids",
    "d6_duplicate_groups": "SELECT * FROM copy_dups",
    "v1_value_counts": "SELECT * FROM counts",
    "v2_canonical_values": "SELECT * FROM canon",
    "v3_exact_matches": "SELECT * FROM exact",
    "v4_representatives": "SELECT * FROM reps",
    "v5_block_keys": "SELECT * FROM members",
    "v7_candidate_pairs": "SELECT * FROM pairs",
    "v8_scored_pairs": """SELECT left_value AS left_normalized_value, right_value AS right_normalized_value,
      round_even(score, 2) AS score FROM scored""",
    "v8_scored_pairs_edit": """SELECT * FROM (SELECT left_value AS left_normalized_value, right_value AS right_normalized_value,
      round_even((1 - levenshtein(left_value, right_value) / greatest(length(left_value), length(right_value))::DOUBLE) * 100, 2) AS score
      FROM pairs) WHERE score >= 80""",
    "v9_directed_matches": "SELECT * FROM fuzzy",
    "v10_strongest_matches": "SELECT * FROM best",
    "v10_strongest_of_all": "SELECT * FROM best",
    "v10_two_forms": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY variant_value ORDER BY similarity_score DESC, canonical_count DESC, canonical_value) AS rn FROM form_variants) WHERE rn = 1",
    "v11_variant_report": "SELECT * FROM variants",
    "v11_variant_report_trade": "SELECT * FROM trade_variants",
    "c1_cleaning_mapping": "SELECT * FROM mapping",
    "c2_accepted_mapping": "SELECT * FROM accepted",
    "c3_normalized_organizations": """SELECT _row_id, recipient_legal_name_normalized_codex,
      recipient_operating_name_normalized_codex, owner_org_title_normalized_codex FROM cleaned""",
    "c4_cleaned_table": "SELECT * FROM cleaned",
    "c4_cleaned_table_exchanged": "SELECT * FROM cleaned",
    "g1_missing_summary": "SELECT recommendation, count(*) AS column_count FROM missing GROUP BY 1",
    "g2_duplicate_summary": "SELECT duplicate_type, count(*) AS group_count FROM dups GROUP BY 1",
    "g3_variant_summary": "SELECT status, count(*) AS pair_count FROM variants GROUP BY 1",
    "g4_cleaning_summary": "SELECT status, count(*) AS mapping_count FROM mapping GROUP BY 1",
    "g5_top_missing": f"SELECT * FROM missing ORDER BY {MISSING_ORDER} LIMIT 10",
    "g5_top_duplicate_groups": f"SELECT * FROM dups ORDER BY {DUPLICATE_ORDER} LIMIT 10",
    "g5_top_variant_pairs": f"SELECT * FROM variants ORDER BY {REPORT_ORDER} LIMIT 10",
    "g6_status_counts": """SELECT count(*) FILTER (WHERE status = 'accepted') AS accepted_count,
      count(*) FILTER (WHERE status = 'review') AS review_count FROM mapping""",
    "g7_distribution": f"""SELECT recommendation AS label, n AS value, {pct("n", "sum(n) OVER ()")} AS share
      FROM (SELECT recommendation, count(*) AS n FROM missing GROUP BY 1)""",
    "g8_bars": f"""SELECT column_name AS label, missing_percentage AS value,
      {pct("missing_percentage", "greatest(max(missing_percentage) OVER (), 1.0)")} AS width
      FROM (SELECT * FROM missing ORDER BY {MISSING_ORDER} LIMIT 10)""",
    "g9_largest_duplicate_groups": "SELECT * FROM dups ORDER BY occurrences DESC, duplicate_type, rule_name, duplicate_key LIMIT 12",
    "g9_first_missing_columns": f"SELECT * FROM missing ORDER BY {MISSING_ORDER} LIMIT 12",
    "g10_accepted_variants": f"SELECT * FROM variants WHERE status = 'accepted' ORDER BY {REPORT_ORDER} LIMIT 10",
    "g10_review_variants": f"SELECT * FROM variants WHERE status = 'review' ORDER BY {REPORT_ORDER} LIMIT 10",
    "g11_accepted_ratio": """SELECT count(*) AS mapped_pairs,
      round_even(avg(CAST(status = 'accepted' AS INTEGER)) * 100, 2) AS accepted_ratio FROM variants""",
    "l1_filter_options": f"""SELECT facet, CAST(position AS INTEGER) AS position, label FROM (
      SELECT facet, label, row_number() OVER (PARTITION BY facet ORDER BY
        CASE WHEN facet = 'owner' THEN -records END, CASE WHEN facet = 'owner' THEN first_row END,
        CASE WHEN facet = 'region' THEN label END, CASE WHEN facet = 'year' THEN -CAST(label AS INTEGER) END) AS position
      FROM facets WHERE facet <> 'region' OR label IN {KNOWN}) WHERE facet <> 'owner' OR position <= 30""",
    "l2_lens_filter": "SELECT * FROM slice",
    "l2_lens_filter_clustered": "SELECT * FROM slice",
    "l3_key_figures": key_figures("cleaned"),
    "l3_key_figures_lens": key_figures("slice"),
    "l4_owner_chart": label_chart("owner"),
    "l4_region_chart": label_chart("region"),
    "l5_year_chart": """SELECT label AS year, records, round(total_value, 2) AS total_value FROM facets
      WHERE facet = 'year' ORDER BY label DESC LIMIT 8""",
    "l5b_label_values": f"""SELECT label, records, round(total_value, 2) AS total_value FROM facets
      WHERE facet = 'owner' ORDER BY {LABEL_ORDER} LIMIT 8""",
    "l6_preview": f"SELECT {PREVIEW} FROM slice ORDER BY _row_id LIMIT 8",
    "l6_preview_status": "SELECT count(*) AS record_count, count(*) > 8 AS truncated, count(*) = 0 AS empty FROM slice",
    "l7_leaders": f"""SELECT facet, label, records, round(total_value, 2) AS total_value,
      {pct("records", "(SELECT count(*) FROM slice)")} AS share FROM (
      SELECT *, row_number() OVER (PARTITION BY facet ORDER BY {LABEL_ORDER}) AS rn FROM slice_facets) WHERE rn = 1""",
    "l8_compare_to_whole": f"""SELECT slice_records, all_records, round(slice_value, 2) AS slice_value, round(all_value, 2) AS all_value,
      {pct("slice_records", "greatest(all_records, 1)")} AS record_share, {pct("slice_value", "greatest(all_value, 1.0)")} AS value_share FROM (
      SELECT count(*) FILTER (WHERE {LENS}) AS slice_records, count(*) AS all_records,
        coalesce(sum({number("agreement_value")}) FILTER (WHERE {LENS}), 0.0) AS slice_value,
        coalesce(sum({number("agreement_value")}), 0.0) AS all_value FROM cleaned)""",
    "l11_search": f"""SELECT {DISPLAY} FROM cleaned WHERE {HIT.format("recipient_legal_name", "NATION_2")}
      OR {HIT.format("recipient_legal_name_cleaned_codex", "NATION_2")} ORDER BY _row_id LIMIT 75""",
    "l11_search_agreement": f"SELECT {DISPLAY} FROM cleaned WHERE {HIT.format('agreement_title_en', 'URGENT')} ORDER BY _row_id LIMIT 40",
    "l11_search_blank": f"SELECT {DISPLAY} FROM cleaned ORDER BY _row_id LIMIT 30",
    "l11_search_status": """SELECT least(count(*), 75) AS result_count, count(*) >= 75 AS truncated FROM cleaned WHERE """
    + " OR ".join(
        HIT.format(c, "NATION_2")
        for c in ("ref_number", "recipient_legal_name", "recipient_legal_name_cleaned_codex", "owner_org_title", "agreement_title_en")
    ),
}

ORACLES: dict[str, str] = {
    **{name: sql(final) for name, final in FINALS.items()},
    "g12_final_facts": final_facts(),
    "l9_insights": insights(),
    "l10_headline_counts": headline(),
}
