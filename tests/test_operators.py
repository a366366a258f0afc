"""Operators on small tables, against values worked out by hand or by brute force."""

import itertools
import random
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cleargrain.functions import scoring, values
from cleargrain.operators import cleaning, closeness, duplicates, lens, profile, roles, summary, variants
from cleargrain.sources import ranking, sinks, tables
from cleargrain.session import scratch_path


def column(spark, data, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_bands(spark):
    pcts = [0.0, 0.02, 4.99, 5.0, 40.0, 40.01, 70.0, 70.01]
    assert column(spark, pcts, "double", values.missing_recommendation) == [
        "Nothing", "Simple Imputation", "Simple Imputation", "Imputation + Missing Flag", "Imputation + Missing Flag",
        "Evaluate Utility", "Evaluate Utility", "Possible Removal",
    ]
    assert column(spark, [95.0, 94.996, 80.0, 79.99], "double", values.score_status) == ["accepted", "review", "review", "rejected"]
    one_of_many = values.percent(F.lit(1), F.lit(224000))
    assert column(spark, [1.0], "double", lambda c: one_of_many) == [0.0]


def test_lexical_types_and_numbers(spark):
    cells = ["TRUE", "2020-01-31", "2020-13-31", " 12.5e3 ", "1d", "", None, "x", "inf"]
    kinds = column(spark, cells, "string", lambda c: values.value_type(c, profile.T.StringType(), lexical=True))
    assert kinds == ["boolean", "date", "text", "numeric", "text", "text", "missing", "text", "text"]
    assert column(spark, cells, "string", values.to_number) == [None, None, None, 12500.0, None, None, None, None, float("inf")]


def test_similarity_vectors():
    """Values published in the scoring library's own documentation."""
    assert scoring.ratio("this is a test", "this is a test!") == pytest.approx(96.55172413793103)
    assert scoring.partial_ratio("this is a test", "this is a test!") == 100.0
    assert scoring.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.9090909)
    assert scoring.weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95.0)
    assert scoring.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert scoring.weighted_ratio("this is a test", "this is a new test") == pytest.approx(95.0)
    assert scoring.weighted_ratio("", "a") == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, r=row, x=x: r[j - 1] + 1 if b[j - 1] == x else max(r[j], left), initial=0))
    return row[-1]


def test_ratio_and_stretch_match_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        a, b = ("".join(draw.choices("AB C", k=draw.randint(1, 9))) for _ in range(2))
        assert scoring.ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
        short, long = sorted((a, b), key=len)
        stretches = {long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long))}
        best = max(200 * lcs(short, s) / (len(short) + len(s)) for s in stretches)
        if len(a) == len(b):
            best = max(best, max(200 * lcs(b, a[max(i, 0) : i + len(b)]) / (len(b) + len(a[max(i, 0) : i + len(b)])) for i in range(1 - len(b), len(a))))
        assert scoring.partial_ratio(a, b) == pytest.approx(best)


def test_prefilter_never_loses_a_match(spark):
    draw = random.Random(11)
    words = ["ALPHA", "ALPHB", "BETA", "BETTA", "GAMA", "GAMMA", "AB", "BA"]
    names = sorted({" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(250)})
    pairs = list(itertools.combinations(names, 2))
    table = spark.createDataFrame(pairs, "a string, b string")
    key = {c: scoring.word_key(F.col(c)) for c in "ab"}
    for floor in (80.0, 95.0):
        kept = {tuple(r) for r in table.filter(scoring.may_reach(F.col("a"), F.col("b"), key["a"], key["b"], floor)).collect()}
        assert {p for p in pairs if scoring.weighted_ratio(*p) >= floor} <= kept


def test_block_keys(spark):
    keys = column(spark, ["PROVINCE OF ONTARIO", "A B C D E"], "string", variants.block_keys)
    assert keys[0] == ["prefix:PROVIN:3", "token:PROVINCE:3", "initials:POO:3"]
    assert keys[1] == ["prefix:ABCDE:1", "token:A:1", "initials:ABCD:1"]


def brute_variants(names):
    """Matches of normalised, counted names by plain loops."""
    blocks = {}
    for name in sorted(names):
        compact = name.replace(" ", "")
        tokens = name.split()
        bucket = len(compact) // 5
        for key in {f"p{compact[:6]}:{bucket}", f"t{tokens[0][:8]}:{bucket}", f"i{''.join(t[0] for t in tokens[:4])}:{bucket}"}:
            blocks.setdefault(key, []).append(name)
    pairs = set()
    for members in blocks.values():
        members = sorted(members)
        pairs |= {tuple(sorted(p)) for p in itertools.combinations(members, 2)}
    return pairs


@pytest.mark.parametrize("part", [7, 512])
def test_pairs_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(variants, "PART_NAMES", part)
    draw = random.Random(part)
    names = {f"{draw.choice(['NORTH', 'NORTHERN', 'SOUTH'])} {draw.choice('ABC')}{draw.randint(0, 9)} INC": draw.randint(1, 5) for _ in range(60)}
    counts = spark.createDataFrame([(n, n, f) for n, f in names.items()], "original_value string, normalized_value string, frequency long")
    members = variants.block_members(variants.representatives(counts))
    got = [tuple(r) for r in variants.candidate_pairs(members).collect()]
    want = brute_variants(names)
    assert len(got) == len(set(got)) and set(got) == want

    names = variants.representatives(counts)
    scored = {(r[0], r[3]): r.score for r in variants.scored_pairs(names).collect()}
    by_hand = {p: scoring.weighted_ratio(*p) for p in want}
    assert scored == pytest.approx({p: s for p, s in by_hand.items() if s >= 80})
    every = variants.strongest_matches(variants.directed_matches(variants.scored_pairs(names)))
    best = variants.strongest_matches(variants.directed_matches(variants.strongest_pairs(names)))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, every.collect()))


def names_of_all_kinds(n):
    draw = random.Random(n)
    words = ["NORTH", "NORTHERN", "SOUTH", "A", "B", "INC", "CO", "OF", "MILL", "MILLS", "0012", "0021", "A"]
    names = {" ".join(draw.choices(words, k=draw.randint(1, 6))) for _ in range(n)}
    names |= {"".join(draw.choices("ABC ", k=draw.randint(1, 9))).strip() for _ in range(n // 3)} | {f"UNIT {draw.randint(0, 400):05d}" for _ in range(n // 3)}
    return {name: draw.randint(1, 4) for name in names if name}


@pytest.mark.parametrize("floor", [55.0, 80.0, 92.0])
def test_pairs_from_what_names_share(spark, monkeypatch, floor):
    """Repeated words, single letters, inner blanks, names far longer than others: as if every pair of a block were scored."""
    monkeypatch.setattr(closeness, "LARGE", 2)
    monkeypatch.setattr(closeness, "PART_NAMES", 40)
    names = names_of_all_kinds(240)
    counts = spark.createDataFrame([(n, n, f) for n, f in names.items()], "original_value string, normalized_value string, frequency long")
    reps = variants.representatives(counts)
    pairs = [tuple(r) for r in variants.candidate_pairs(variants.block_members(reps)).collect()]
    want = {p: s for p in pairs if (s := scoring.weighted_ratio(*p)) >= floor}
    found = [((r[0], r[3]), r.score) for r in variants.scored_pairs(reps, floor).collect()]
    assert len(found) == len(dict(found)) and dict(found) == pytest.approx(want)

    weight = {n: (f, len(n), n) for n, f in names.items()}
    best = {}
    for pair, score in want.items():
        variant, canonical = sorted(pair, key=weight.get)
        rank = (-float(Decimal(repr(score)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)), -names[canonical], canonical)
        best[variant] = min(best.get(variant, rank), rank)
    got = {r.variant_value: (-r.similarity_score, -r.canonical_count, r.canonical_value) for r in variants.strongest_fuzzy_matches(counts, min_similarity=floor).collect()}
    assert got == best


def test_edit_pairs_from_what_names_share(spark, monkeypatch):
    monkeypatch.setattr(closeness, "LARGE", 2)
    names = names_of_all_kinds(200)
    counts = spark.createDataFrame([(n, n, f) for n, f in names.items()], "original_value string, normalized_value string, frequency long")
    reps = variants.representatives(counts)
    every = variants.candidate_pairs(variants.block_members(reps))
    alike = (1 - F.levenshtein("left_value", "right_value") / F.greatest(F.char_length("left_value"), F.char_length("right_value"))) * 100
    want = {tuple(r) for r in every.filter(alike >= 70).collect()}
    assert {(r[0], r[3]) for r in variants.scored_pairs(reps, 70.0, "edit").collect()} == want and want


def best_by_hand(names, pairs, floor):
    """Rank of the best match with a preferred name, by plain loops."""
    weight, best = {n: (f, len(n), n) for n, f in names.items()}, {}
    for pair in pairs:
        if (score := scoring.weighted_ratio(*pair)) >= floor:
            variant, canonical = sorted(pair, key=weight.get)
            rank = (-float(Decimal(repr(score)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)), -names[canonical], canonical)
            best[variant] = min(best.get(variant, rank), rank)
    return best


@pytest.mark.parametrize("floor", [80.0, 93.0])
def test_names_one_letter_apart(spark, monkeypatch, floor):
    """Letters changed, moved, added, taken out, words turned round, in names on both sides of where one letter decides."""
    monkeypatch.setattr(closeness, "LARGE", 2)
    draw, names = random.Random(int(floor)), {}
    for stem in ("MILL TOWN 00", "MILL NORTHERN 0", "MILL AND MILL SON 0", "MILL ÉÉ 00000000"):
        for _ in range(60):
            name = stem + "".join(draw.choices("0123", k=draw.randint(2, 4)))
            turned = " ".join(reversed(name.split())) if draw.random() < 0.1 else name
            names[turned] = draw.randint(1, 4)
    counts = spark.createDataFrame([(n, n, f) for n, f in names.items()], "original_value string, normalized_value string, frequency long")
    got = {r.variant_value: (-r.similarity_score, -r.canonical_count, r.canonical_value) for r in variants.strongest_fuzzy_matches(counts, min_similarity=floor).collect()}
    assert got == best_by_hand(names, brute_variants(names), floor) and len(got) > 100


def test_the_best_match_is_found_without_all_close_pairs(spark, monkeypatch):
    names = {f"CUSTOMER {i * 7919 % 10000:09d}": 1 + i % 4 for i in range(1600)}
    counts = spark.createDataFrame([(n, n, f) for n, f in names.items()], "original_value string, normalized_value string, frequency long")
    scored, made = closeness._scored, []

    def counted(pairs, floor, metric):
        made.append(pairs.count())
        return scored(pairs, floor, metric)

    monkeypatch.setattr(closeness, "_scored", counted)
    got = {r.variant_value: (-r.similarity_score, -r.canonical_count, r.canonical_value) for r in variants.strongest_fuzzy_matches(counts).collect()}
    assert sum(made) < 4 * len(names)
    some = list(names)[::200]
    for name in some:
        others = [tuple(sorted((name, other))) for other in names if other != name]
        assert got.get(name) == best_by_hand(names, others, 80.0).get(name)


def test_few_of_the_pairs_of_a_block_meet(spark, monkeypatch):
    monkeypatch.setattr(closeness, "LARGE", 2)
    rows = [(f"UNIT {i * 37 % 9973:05d} {i * 91 % 997:03d}",) * 2 + (1 + i % 3,) for i in range(1600)]
    reps = spark.createDataFrame(rows, "normalized_value string, original_value string, frequency long")
    made = closeness.listed(*closeness.ranked(reps, variants.block_keys), 89.99)
    together = made.groupBy("block", "kind", "choice").count()
    assert together.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] < 0.02 * 1600 * 1599 / 2


def test_a_block_of_thousands_loses_no_name(spark):
    """2,500 names in one block: each is compared with all, though only one match each is kept."""
    names = [f"CUSTOMER {i * 7 % 2500:09d}" for i in range(2500)]
    counts = spark.createDataFrame([(n, n, 1 + (i % 3 == 0)) for i, n in enumerate(names)], "original_value string, normalized_value string, frequency long")
    got = {r.variant_value: (r.similarity_score, r.canonical_value) for r in variants.strongest_fuzzy_matches(counts).collect()}
    assert len(got) == 2499
    weights = {n: (1 + (i % 3 == 0), len(n), n) for i, n in enumerate(names)}
    for name in names[::250]:
        ranked = sorted(
            (-round(scoring.weighted_ratio(name, other), 2), -weights[other][0], other) for other in names if weights[other] > weights[name]
        )
        assert not ranked or got[name] == (-ranked[0][0], ranked[0][2])


def test_variants_do_not_depend_on_layout(spark):
    data = [(v,) for v in ["Acme Inc", "ACME INC.", "acme-inc", "Acme Ink", "Zeta Ltd", None, " ", "Acme Inc"]]
    first = spark.createDataFrame(data, "recipient_legal_name string")
    reports = [
        sorted(tuple(r) for r in variants.variant_report(t).collect()) for t in (first, first.repartition(5), first.coalesce(1))
    ]
    assert reports[0] == reports[1] == reports[2]
    names = [r[1] for r in reports[0]]
    assert len(names) == len(set(names)) == 3
    for row in variants.variant_report(first).collect():
        assert (row.canonical_count, len(row.canonical_value), row.canonical_value) > (row.variant_count, len(row.variant_value), row.variant_value)


def test_variants_of_nothing_keep_their_columns(spark):
    empty = spark.createDataFrame([(None,)], "recipient_legal_name string")
    report = variants.variant_report(empty)
    assert report.columns == variants.VARIANT_SCHEMA.names and report.count() == 0
    assert cleaning.cleaning_mapping(report).columns == cleaning.MAPPING_SCHEMA.names
    with pytest.raises(ValueError):
        variants.variant_report(spark.createDataFrame([(1,)], "x int"))


@pytest.mark.parametrize("broadcast_rows", [10, 0])
def test_mapping_is_one_hop_and_keeps_rows(spark, broadcast_rows):
    mapping = spark.createDataFrame(
        [("A", "B", "accepted", "", 100.0, "c"), ("B", "C", "accepted", "", 99.0, "c"), ("D", "E", "review", "", 85.0, "c"),
         (" A", "Z", "accepted", "", 100.0, "c")],
        cleaning.MAPPING_SCHEMA,
    )
    table = spark.createDataFrame(
        [(1, "A"), (2, "B"), (3, " X "), (4, None), (5, "D"), (6, " A ")], "_row_id long, recipient_legal_name string"
    )
    done = cleaning.cleaned_table(table, mapping, broadcast_rows=broadcast_rows).orderBy("_row_id").collect()
    assert [r.recipient_legal_name_cleaned_codex for r in done] == ["B", "C", " X ", None, "D", "B"]
    assert [r.recipient_legal_name for r in done] == ["A", "B", " X ", None, "D", " A "]


def test_probable_key_needs_four_parts(spark):
    schema = "_row_id long, recipient_legal_name string, agreement_title_en string, agreement_title_fr string, agreement_value string, agreement_start_date string, agreement_end_date string, owner_org string"
    rows = [
        (1, "Org", None, None, None, "2020", None, "own"),
        (2, "Org", None, None, "5", "2020", None, "own"),
        (3, None, "t", "t", "5", "2020", "2021", "own"),
        (4, "Org", "", "Été", None, "2020", None, "own"),
        (5, "Org", " ", "Été", None, "2020", None, "own"),
    ]
    table = spark.createDataFrame(rows, schema)
    keys = [r.probable_key for r in duplicates.with_probable_key(table).orderBy("_row_id").collect()]
    assert keys == [
        None,
        "ORG | <MISSING> | 5 | 2020 | <MISSING> | own",
        None,
        "ORG | ETE | <MISSING> | 2020 | <MISSING> | own",
        None,
    ]


def test_exact_duplicates_match_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, i, draw.choice(["a", " a", None, "<MISSING>"]), draw.choice([1.0, float("nan"), None])) for i in range(60)]
    table = spark.createDataFrame(rows, "_row_id long, `#` long, ref_number string, v double")
    groups = duplicates.exact_duplicates(table).collect()

    def key(value):
        return "<MISSING>" if value is None or value != value else str(value).strip()

    want = Counter(f"{key(r)} || {key(v)}" for _, _, r, v in rows)
    assert {g.duplicate_key: g.occurrences for g in groups} == {k: n for k, n in want.items() if n > 1}


def test_profile_of_gaps_and_samples(spark):
    rows = [(i, None if i < 40 else f"v{i}", None, i / 2 if i % 2 else float("nan")) for i in range(50)]
    table = spark.createDataFrame(rows, "_row_id long, late string, never string, number double")
    got = {r.column_name: r for r in profile.column_profile(table).collect()}
    assert got["late"].sample_values == "v40, v41, v42" and got["late"].missing_percentage == 80.0
    assert got["never"].sample_values == "" and got["never"].non_null_count == 0
    assert got["number"].sample_values == "0.5, 1.5, 2.5" and got["number"].missing_count == 25
    lexical = {r.column_name: r.inferred_type for r in profile.column_profile(table, lexical=True).collect()}
    assert lexical == {"late": "text", "never": "unknown", "number": "numeric"}


def test_type_ties(spark):
    table = spark.createDataFrame([(1, "x"), (2, "5")], "_row_id long, c string")
    counts = profile.column_counts(table, lexical=True)
    assert counts.select(profile.inferred_type()).first()[0] == "numeric"
    assert counts.select(profile.inferred_type(first_seen=True)).first()[0] == "text"


def test_roles():
    headers = ["owner_org_title", "recipient_operating_name", "x", "recipient_legal_name_clean", "ref_number"]
    assert roles.organization_columns(headers) == ["recipient_legal_name_clean", "recipient_operating_name", "owner_org_title"]
    assert roles.primary_organization(headers) == "recipient_legal_name_clean"
    assert roles.primary_organization(["owner_org_title"]) == "owner_org_title"
    assert roles.primary_organization(["x"]) is None
    assert roles.duplicate_columns(headers) == ["ref_number", "recipient_operating_name"]
    with pytest.raises(ValueError):
        roles.require_primary_organization(["x"])


def test_table_ranking(spark):
    good = ["ref_number", "recipient_name", "agreement_value", "city", "date", None]
    data = [(0, "notes", 50, ["a", "b"]), (1, "Data REV-2", 10, good), (2, "data rev-10", 9, good), (3, "data rev-10", 9, good), (4, "empty rev-11", 0, good)]
    profiles = spark.createDataFrame(data, "position int, table_name string, row_count long, headers array<string>")
    ranked = ranking.rank_tables(profiles)
    best = ranking.primary_table(ranked).first()
    assert (best.position, best.revision, best.non_empty_headers) == (2, 10, 5)
    # A blank header becomes "unnamed_column_06", which holds the word "name".
    assert best.score == 6
    assert {r.position for r in ranked.filter("is_candidate").collect()} == {1, 2, 3}


def test_csv_padding_cutting_and_empty_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id , ,b\n1,"",x\n2,y\n3,,z,extra\n', encoding="utf-8")
    table = tables.read_csv(spark, str(path), key="id")
    assert tables.header(table) == ["id", "unnamed_column_02", "b"]
    got = [tuple(r) for r in table.orderBy("_row_id").collect()]
    assert got == [("1", "", "x", 1), ("2", "y", None, 2), ("3", None, "z", 3)]


def test_reports_are_read_or_missed(spark, tmp_path):
    absent = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, absent, cleaning.MAPPING_SCHEMA)
    empty = tables.read_report(spark, absent, cleaning.MAPPING_SCHEMA, required=False)
    assert empty.count() == 0 and empty.columns == cleaning.MAPPING_SCHEMA.names
    with pytest.raises(ValueError):
        tables.head_rows(empty, 0)


def test_outputs_never_touch_inputs(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (tmp_path / "link").symlink_to(raw)
    for bad in (raw, raw / "out", tmp_path, tmp_path / "link" / "x", tmp_path / "other" / ".." / "raw"):
        with pytest.raises(ValueError):
            sinks.check_output(str(bad), [str(raw)])
    with pytest.raises(ValueError):
        sinks.check_output("s3://bucket/raw/out", ["s3://bucket/raw"])
    assert sinks.check_output(str(tmp_path / "rawer"), [str(raw)])
    table = spark.range(3).select(F.col("id").cast("string").alias("a"))
    written = sinks.write_table(table, scratch_path(spark, "t"), protected=[str(raw)], fmt="csv")
    assert tables.read_csv(spark, written, key="a").count() == 3


def test_lens_on_an_empty_slice(spark):
    schema = "_row_id long, ref_number string, recipient_legal_name string, recipient_legal_name_cleaned_codex string, owner_org_title string, recipient_province_clean string, agreement_title_en string, agreement_value string, agreement_start_date string"
    table = spark.createDataFrame([(1, "r", "Org", None, " Own ", "ON", None, "10", "2020-01-01"), (2, "s", "Org", "", "Own", "xx", "T", "bad", "n/a")], schema)
    none = lens.lens_filter(table, lens.Lens(search="zzz"))
    figures = lens.key_figures(none).first()
    assert tuple(figures) == (0, 0.0, 0.0, 0, 0)
    assert tuple(lens.preview_status(none).first()) == (0, False, True)
    whole = lens.key_figures(table).first()
    assert tuple(whole) == (2, 10.0, 10.0, 1, 1)
    assert lens.leaders(table).filter("facet = 'owner'").first().share == 100.0
    assert lens.compare_to_whole(table, lens.Lens(region="on")).first().record_share == 50.0
    assert not lens.Lens(search=" ").active
    assert lens.search_status(lens.search(table, "org", limit=2), "org", 2).first().truncated


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], variants.VARIANT_SCHEMA)
    assert tuple(summary.accepted_ratio(empty).first()) == (0, 0.0)
    assert tuple(summary.status_counts(empty).first()) == (0, 0)
    assert summary.distribution(summary.variant_summary(empty), "status", "pair_count").count() == 0


def test_few_long_names_are_not_broadcast_and_a_hot_name_is_split(spark):
    long = "N" * 50_000
    mapping = spark.createDataFrame([(long, "Short", "accepted", "", 100.0, "c"), ("Hot", "Cold", "accepted", "", 100.0, "c")], cleaning.MAPPING_SCHEMA)
    table = spark.createDataFrame([(i, "Hot" if i % 2 else long if i % 4 else None) for i in range(400)], "_row_id long, recipient_legal_name string")
    done = cleaning.apply_mapping(table, mapping, "recipient_legal_name", broadcast_bytes=1_000)
    text = done._jdf.queryExecution().optimizedPlan().toString()
    # What is broadcast are the hashes of hot names, not the mapping.
    assert text.count("strategy=broadcast") == 2 and "Generate explode" in text and text.count("_hash") > 2
    got = Counter(r[-1] for r in done.collect())
    assert got == {"Cold": 200, "Short": 100, None: 100}


def test_only_hot_names_are_dealt_into_parts(spark):
    names = ["Hot"] * 900 + ["Warm"] * 100 + [None] * 500 + [f"n{i}" for i in range(300)] + [" Hot "] * 100
    table = spark.createDataFrame(list(enumerate(names)), "_row_id long, recipient_legal_name string")
    rows = [("Hot", "Cold", "accepted", "", 100.0, "c"), ("n7", "Seven", "accepted", "", 100.0, "c"), ("gone", "x", "accepted", "", 100.0, "c")]
    mapping = spark.createDataFrame(rows, cleaning.MAPPING_SCHEMA)
    hot = cleaning.hot_names(table.selectExpr("trim(recipient_legal_name) AS _name"), 100)
    assert [tuple(r) for r in hot.collect()] == [(spark.range(1).select(F.xxhash64(F.lit("Hot"))).first()[0], 10)]
    assert cleaning.hot_names(table.selectExpr("recipient_legal_name AS _name").limit(0), 100).count() == 0
    for hot_rows in (100, 10_000):
        done = cleaning.apply_mapping(table, mapping, "recipient_legal_name", broadcast_rows=0, hot_rows=hot_rows).collect()
        want = {i: {"Hot": "Cold", "n7": "Seven"}.get((n or "").strip(), n) for i, n in enumerate(names)}
        assert {r[0]: r[-1] for r in done} == want and len(done) == len(names)


def test_shared_word_does_not_send_every_pair_to_python(spark):
    names = [f"CUSTOMER {a}{b}" for a in ("ALDER", "BIRCHWOOD", "CYPRESS", "DOGWOODS", "EBONY TREE") for b in ("", " NORTH", " 77", " XYZ", " QQQQ")]
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
    passed = pairs.filter(scoring.may_reach(F.col("a"), F.col("b"), scoring.word_key(F.col("a")), scoring.word_key(F.col("b")), 80.0)).collect()
    reach = {p for p in itertools.combinations(names, 2) if scoring.weighted_ratio(*p) >= 80}
    assert reach <= {tuple(r) for r in passed} and len(passed) < 0.6 * pairs.count()


def test_a_year_of_a_clustered_table_is_in_few_files(spark, tmp_path):
    """Half of the rows are of one day and spread over several files all the same; nulls and equal rows stay."""
    day = "CASE WHEN id % 2 = 0 THEN DATE'2015-05-05' WHEN id % 11 = 0 THEN NULL ELSE date_add(DATE'2010-01-01', CAST(id % 3650 AS INT)) END"
    table = spark.range(20_000).selectExpr("id AS _row_id", f"{day} AS agreement_start_date", "CAST(id % 7 AS STRING) AS region")
    table = table.union(table.filter("_row_id < 50"))
    by = ["agreement_start_date", "region"]
    path = str(tmp_path / "clustered")
    sinks.clustered(table, by, parts=20).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.exceptAll(table).isEmpty() and table.exceptAll(stored).isEmpty()
    spans = [
        (stats.min.isoformat(), stats.max.isoformat())
        for file in (tmp_path / "clustered").glob("*.parquet")
        for group in [pq.ParquetFile(file).metadata.row_group(0)]
        for stats in [next(c.statistics for c in (group.column(i) for i in range(group.num_columns)) if c.path_in_schema == by[0])]
        if stats.has_min_max
    ]
    touched = {year: sum(low <= f"{year}-12-31" and high >= f"{year}-01-01" for low, high in spans) for year in range(2010, 2020)}
    assert touched.pop(2015) >= 9 and max(touched.values()) <= 3
    for year in (2012, 2015):
        found = lens.lens_filter(stored, lens.Lens(year=str(year)))
        assert found.count() == table.filter(f"year(agreement_start_date) = {year}").count()
    sinks.write_table(table.limit(0), path, protected=[], cluster_by=by)
    assert spark.read.parquet(path).count() == 0


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "cleaned")
    sinks.write_table(spark.range(1000).repartition(4), path, protected=[])
    broken = spark.range(2000).repartition(4).select(F.when(F.col("id") == 1500, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(broken, path, protected=[])
    assert spark.read.parquet(path).count() == 1000 and [p.name for p in tmp_path.iterdir()] == ["cleaned"]
    # A table replaces the one that it comes from.
    sinks.write_table(spark.read.parquet(path).filter("id < 10"), path, protected=[])
    assert spark.read.parquet(path).count() == 10


def test_a_lost_writer_is_made_good(spark, tmp_path):
    path = tmp_path / "report"
    sinks.write_table(spark.range(5), str(path), protected=[])
    path.rename(f"{path}{sinks.PREVIOUS}")
    assert tables.read_report(spark, str(path), spark.range(1).schema, fmt="parquet").count() == 5
    path.rename(f"{path}{sinks.PREVIOUS}")
    assert sinks.recover(spark, str(path)) and not sinks.recover(spark, str(path)) and spark.read.parquet(str(path)).count() == 5
    assert not sinks.recover(spark, str(tmp_path / "never"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_rows_keep_their_numbers_however_files_are_split(spark, tmp_path, fmt):
    path = str(tmp_path / "rows")
    spark.range(4000).select(F.col("id").cast("string").alias("a"), F.repeat(F.lit("x"), 200).alias("b")).repartition(5).write.option("header", True).option("parquet.block.size", 40_000).format(fmt).save(path)
    read = {"parquet": tables.read_parquet, "csv": tables.read_csv}[fmt]
    name, numbers = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(name)
    for size in ("20k", "64m"):
        spark.conf.set(name, size)
        numbers.append({r["a"]: r["_row_id"] for r in read(spark, path).select("a", "_row_id").collect()})
    spark.conf.set(name, before)
    assert numbers[0] == numbers[1] and sorted(numbers[0].values()) == list(range(4000))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_numbering_rows_of_a_file_exchanges_none_of_them(spark, tmp_path, fmt):
    path = str(tmp_path / "rows")
    spark.range(500).select(F.col("id").cast("string").alias("a")).coalesce(1).write.option("header", True).format(fmt).save(path)
    rows = {"parquet": tables.read_parquet, "csv": tables.read_csv}[fmt](spark, path)
    assert [(r.a, r._row_id) for r in rows.orderBy("_row_id").collect()] == [(str(i), i) for i in range(500)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
