"""Each operator on odd input, against plain versions, and on the given tables."""

import hashlib
import os
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from compare import connect, differences
from conftest import TEXTS
from pyspark.sql import functions as F

import corpus_pipeline
from cleargrain.llm import bpe, chat, covertree, digest, language, minhash, mixing, quality, suffix_index, toxicity
from cleargrain.llm.components import connected_components
from cleargrain.llm.queries import ORACLES, QUERIES
from cleargrain.llm.texts import held_out

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LEARN_DIR = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.01")
TWICE = [*TEXTS, TEXTS[1]]


def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


# 1


def test_repeats_on_odd_rows(odd, no_rows):
    got = suffix_index.remove_repeats(odd, 60, batches=3)
    want = Counter(zip((d for d, *_ in TWICE), brute.repeats([t for _, t, *_ in TWICE], 60), strict=True))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.collect()) == want
    assert suffix_index.remove_repeats(no_rows, 60).count() == 0


def test_repeats_window_by_window(odd, monkeypatch):
    monkeypatch.setattr(suffix_index, "TOGETHER", 1)
    got = suffix_index.remove_repeats(odd, 60, batches=2)
    want = Counter(brute.repeats([t for _, t, *_ in TWICE], 60))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_rows_without_ids_are_told_apart(spark):
    """Texts whose 32-bit hashes agree; one of them repeats nothing, the other is a copy's."""
    words = spark.range(150_000).select(F.concat(F.lit("x"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 1), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    twins = words.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").orderBy("h").first()
    assert twins
    texts = [twins.t[0], twins.t[1], twins.t[1][:-1] + "!", None, ""]
    for ids in ([None] * 5, [7] * 5):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        got = suffix_index.remove_repeats(docs, 60).collect()
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute.repeats(texts, 60))


def test_op1(spark):
    texts = given(spark)
    want = dict(zip(texts, brute.repeats(list(texts.values()), 400), strict=True))
    got = QUERIES["op1_suffix_array_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


# 2


def test_chat_on_odd_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 3, "ann", "x"), (1, 3, "ann", "x"),
        (2, 0, "system", "alone"), (None, None, "ann", "no id"), (None, 5, "bob", ""), (3, 700, "ann", "late"), (3, 1, "ann", "early"),
    ]
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, size int, own string")
    got = chat.rotate(table, piece=2).collect()
    sides = defaultdict(list)
    for r in got:
        sides[(r.conv_id, r.perspective)].append(r)
    assert set(sides) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob"), (3, "ann")}
    for (_, side), turns in sides.items():
        turns.sort(key=lambda r: r.start)
        whole = "".join(r.rendered for r in turns)
        assert [r.start for r in turns] == [0, *(r.stop for r in turns[:-1])] and turns[-1].stop == len(whole)
        for r in turns:
            assert whole[r.start : r.stop] == r.rendered and r.loss == int(r.speaker == side)
            if r.loss:
                assert whole[r.loss_start : r.loss_stop].endswith("<|im_end|>\n") and whole[r.start : r.loss_start] == "<|im_start|>assistant\n"
    assert [r.speaker for r in sides[(1, "ann")]] == ["system", "ann", "bob", "ann", "ann", "unknown"]
    assert chat.rotate(table.limit(0)).count() == 0


# 3


def test_top_k_on_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [9.0, 9.0]), (7, [1.0]), (100, [2.0, 2.0]), (200, [1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    data = covertree.whole_vectors(table)
    got = [tuple(r) for r in covertree.top_k(data, data.filter("vec_id % 100 = 0"), 2).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 100, 6 * one), (0, 2, 1, 5 * one), (100, 1, 2, 7 * one), (100, 2, 0, 6 * one), (200, 1, 7, one)]
    assert covertree.top_k(data.limit(0), data.limit(0)).count() == 0


def test_top_k_of_an_id_with_many_vectors(spark, tmp_path):
    """Eleven high vectors of one id, a query id with two vectors, and more rows than a leaf holds."""
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.5]), (100, [-1.0, 0.25])] + [(1, [9.0 + j, 0.5]) for j in range(11)]
    rows += [(1, [-5.0 - j, 1.0]) for j in range(3)] + [(k, [k / 64, -k / 32]) for k in range(2, 90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    data = covertree.whole_vectors(table)
    queries = data.filter("vec_id % 100 = 0")
    table.write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    for k in (10, 15):
        want = con.execute(covertree.OP3_SQL.replace("rank <= 10", f"rank <= {k}")).fetchall()
        got = [tuple(r) for r in covertree.top_k(data, queries, k).collect()]
        assert len(want) == 2 * k and sorted(got) == sorted(want)


# 4, 5, 8


def test_language_on_odd_rows(odd, no_rows):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, F.lit(False)).collect()}
    assert {d for d, (name, _) in got.items() if name == "und"} == {4, 5, 6, 14}
    assert got[10][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.identify(odd, F.lit(True)).collect()} == {"und"}
    assert language.identify(no_rows, F.lit(False)).count() == 0


def test_language_equals_plain_bayes_however_many_there_are(spark):
    """300 languages, null and repeated ids; small slices find what one slice finds."""
    rows = [(None if k % 3 else k % 5, f"{chr(0x61 + k % 26)}{chr(0x4E00 + k)}{chr(0x4E00 + k)} shared {k % 7}", f"x{k:03d}") for k in range(300)]
    docs = spark.createDataFrame([*rows, *rows, (1, "shared", None)], "doc_id long, text string, lang string")
    want = brute.languages([(t, n) for _, t, n in [*rows, *rows]], [t for _, t, _ in rows])
    for size in (90, language.SLICE, 400):
        learned = language.learn(docs, slice_size=size)
        got = {r.text2: (r.lang_pred, r.score) for r in language.predict(docs.withColumn("text2", F.col("text")), learned).collect()}
        for (_, text, lang), (name, score) in zip(rows, want, strict=True):
            assert got[text][0] == name == lang and abs(got[text][1] - score) < 1e-4
    kept = language.predict(docs.selectExpr("text", "'a' AS best_", "1 AS score"), language.learn(docs))
    assert kept.columns == ["best_", "lang_pred", "score"] and kept.filter("best_ = 'a'").count() == 601


def test_op4(spark):
    got = QUERIES["op4_language_id"](spark, LEARN_DIR)
    truth = spark.read.parquet(f"{LEARN_DIR}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out")
    assert held.count() > 200 and held.filter("lang_pred = lang").count() >= 0.98 * held.count()
    assert got.count() == truth.count()


def _measured(spark, name, label):
    got = QUERIES[name](spark, LEARN_DIR)
    assert got.count() == spark.read.parquet(f"{LEARN_DIR}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{LEARN_DIR}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", label).collect()
    right, wrong = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in right for b in wrong) / len(right) / len(wrong)
    return area, sum(r.predicted == r[label] for r in rows) / len(rows)


def test_op5(spark):
    area, accuracy = _measured(spark, "op5_quality_classifier", "quality")
    assert area > 0.95 and accuracy > 0.93


def test_op8(spark):
    area, accuracy = _measured(spark, "op8_toxicity", "toxic")
    assert area > 0.85 and accuracy > 0.93


LABELS = "doc_id long, quality int, toxic int"


def test_classifiers_on_odd_rows(spark, odd, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (12, 0, 1), (99, 1, 1), (None, 1, 1), (4, 1, 0), (9, 1, 0)], LABELS)
    empty = labels.limit(0)
    for docs in (odd, no_rows):
        for marks in (labels, empty):
            model, prior = quality.learn(docs.select("doc_id", "text"), marks)
            got = quality.score(docs.select("doc_id", "text"), model).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and 0 < prior < 1
            by_id = {r.doc_id: r.score for r in got}
            assert not by_id or by_id[4] == by_id[5]
            got = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs.select("doc_id", "text"), marks)).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_offending_sentence_is_found(spark):
    texts = [(k, "calm words here. " * (k % 5 + 1) + ("you utter fool! " if k % 4 == 0 else "") + "more of them. " * (k % 3), k % 4 == 0) for k in range(200)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], int(t[2])) for t in texts], "doc_id long, toxic int")
    for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect():
        text = dict(t[:2] for t in texts)[r.doc_id]
        assert r.predicted == int("fool" in text)
        assert [text[s.start : s.stop].strip() for s in r.offending] == (["you utter fool!"] if r.predicted else [])


# 6


def test_mix_on_odd_rows(odd, no_rows):
    got = mixing.mix(odd).collect()
    sizes = Counter()
    for _, text, _, source in TWICE:
        sizes[source] += len(brute.WORD.findall(text or ""))
    want = brute.targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert len(got) == len(TWICE) and all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert mixing.mix(no_rows).count() == 0


def test_op6(spark):
    first = {r.doc_id: tuple(r) for r in QUERIES["op6_source_mixing"](spark, SF_DIR).collect()}
    again = {r.doc_id: tuple(r) for r in QUERIES["op6_source_mixing"](spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        own = len(brute.WORD.findall(r.text or ""))
        sizes[r.source] += own
        taken[r.source] += first[r.doc_id][4]
        assert first[r.doc_id][1] == own and 0 <= first[r.doc_id][4] <= 2 * own
    want = brute.targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    assert first == again and len(first) == len(rows)
    for r in rows:
        assert abs(first[r.doc_id][3] - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_larger_documents_are_likelier(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 40).otherwise(4).cast("int")).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs, share=1.3).groupBy((F.col("size") > 10).alias("large")).agg(F.avg(F.col("taken") / F.col("size")).alias("copies")).collect()
    by = {r.large: r.copies for r in got}
    assert by[True] > by[False] + 0.1 and by[False] >= 1
    words = mixing.repeated(mixing.mix(docs, share=1.3)).agg(F.sum(F.regexp_count("text", F.lit(r"w")))).first()[0]
    assert abs(words - 1.3 * 4_000 * 22) <= 1


# 7


def test_near_duplicates_on_odd_rows(odd, no_rows):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, shingle=3, percent=80).collect()]
    want = brute.components({d: t for d, t, *_ in TEXTS}, 3, 80)
    assert Counter(got) == Counter((d, *want[d]) for d, *_ in TWICE)
    assert minhash.near_duplicates(no_rows).count() == 0


def test_op7(spark):
    want = brute.components(given(spark), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_minhash_near_dedup"](spark, SF_DIR).collect()} == want


def test_group_around_no_single_leader(spark):
    """Each text is close to its neighbours only, so no star holds the group together."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([f"v{i}" if i < 12 * k else w for i, w in enumerate(words)])) for k in range(25)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=3, percent=80).collect()}
    assert got == {k: c for k, (_, c, _) in brute.components(dict(rows), 3, 80).items()} and got[24] == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9


def _edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        yield d, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_fingerprints_on_odd_rows(odd, no_rows):
    got = digest.edited_neighbours(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(_edited([r[:2] for r in TWICE]))
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert by_id[1] == by_id[3] and by_id[4] == by_id[5] and by_id[7] != by_id[8]
    assert {r.fingerprint for r in digest.fingerprints(odd.select("doc_id", "text")).collect()} == {*by_id.values()}
    assert digest.edited_neighbours(no_rows).count() == 0
    one = digest.edited_neighbours(odd.filter("doc_id = 10")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_op9(spark):
    got = QUERIES["op9_document_fingerprints"](spark, SF_DIR).collect()
    texts = given(spark)
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == set(_edited(texts.items()))
    prints = {r.doc_id: r.fingerprint for r in got}
    order = sorted(prints, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in got:
        assert abs(digest.likeness(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 1e-9
        assert abs(digest.likeness(r.fingerprint, prints[after[r.doc_id]]) - r.near_next) < 1e-9
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


# 10


def test_bpe_on_odd_rows(odd, no_rows):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.encode(odd.select("doc_id", "text", "size"), path, tokenizers.PATTERN, keep_ids=True)
    texts = {d: t or "" for d, t, *_ in TEXTS}
    got = bpe.decode(encoded, path).collect()
    assert len(got) == len(TWICE)
    for r in got:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(no_rows.select("doc_id", "text"), path, tokenizers.PATTERN).count() == 0


def test_op10(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = given(spark)
    for r in QUERIES["op10_byte_bpe"](spark, SF_DIR).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = given(spark)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        if name == "quality classifier":
            good = QUERIES["op5_quality_classifier"](spark, SF_DIR).filter("predicted = 1").collect()
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in good}
        if name == "mixing sources to target weights":
            sizes, taken = Counter(), Counter()
            for table, count in ((before, sizes), (docs, taken)):
                for r in table.collect():
                    count[r.source] += len(brute.WORD.findall(r.text))
            want = brute.targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
            assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
            whole = {r.doc_id: r.text for r in before.collect()}
            assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in docs.collect())
        if name == "byte-level BPE":
            tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
            ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = Counter((r.doc_id, tuple(plain.encode_ordinary(r.text))) for r in before.collect())
            assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want
        if name == "MinHash near-dedup":
            groups = brute.components({r.doc_id: r.text for r in before.collect()}, 5, 80)
            assert {r.doc_id for r in docs.collect()} == {d for d, (_, _, kept) in groups.items() if kept}
        if name == "suffix-array dedup":
            rows = before.orderBy("doc_id").collect()
            cut = brute.repeats([r.text for r in rows], corpus_pipeline.REPEAT_BYTES)
            for r, (_, gone, _, _) in zip(docs.orderBy("doc_id").collect(), cut, strict=True):
                assert (gone == 0) == (r.text == texts[r.doc_id]) and r.n_chars == len(r.text)
    assert len(seen) == 5 and docs.count() > 0 and docs.filter("n_tokens = 0").count() == 0


def test_stages_on_odd_rows(spark, odd, no_rows):
    rows = odd.select(*corpus_pipeline.COLUMNS)
    near = corpus_pipeline.one_of_each_group(spark, rows, SF_DIR).collect()
    assert sorted(r.doc_id for r in near) == [1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14]
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, no_rows.select(*corpus_pipeline.COLUMNS), SF_DIR).count() == 0


def test_passages_of_fifty_words_go(spark):
    """Planted in two documents each, 51 to 60 words of two to five letters: under 400 bytes."""
    short = ["ab", "efg", "hij", "klmn", "opqrs"]
    passages = {n: " ".join(f"{short[i % 5][:-1]}{chr(97 + (i * n + i // 5) % 26)}" for i in range(n)) for n in range(51, 61)}
    assert all(200 <= len(p) < 400 for p in passages.values())
    own = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(20)]
    rows = [(d, f"{own[d]} | {passages[51 + d // 2]} # {own[d][::-1]}", "en", "a") for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, SF_DIR).collect()}
    assert len(got) == 20
    for d in range(20):
        assert passages[51 + d // 2][:20] not in got[d].text and passages[51 + d // 2][-20:] not in got[d].text and got[d].n_chars == len(got[d].text)
        assert got[d].text.startswith(own[d].rsplit(" ", 1)[0]) and got[d].text.endswith(own[d][::-1].split(" ", 1)[1])


def test_groups_with_null_and_repeated_ids(spark):
    """Only near duplicates go, whatever the ids: one of each pair of texts stays."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(12)]
    ids = [None, None, None, None, 7, 7, 7, 8, 9, 10, None, 7]
    near = [(ids[(k * 5) % 12], t + " tail") for k, t in enumerate(texts)]
    rows = [*zip(ids, texts, strict=True), *near, (None, texts[0]), (None, ""), (None, None), (7, " ")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()
    kept = Counter((r.text or "").split(" ")[0] for r in got)
    assert kept == Counter({**{f"t{k}w0": 1 for k in range(12)}, "": 3})
    for k, text in enumerate(texts):
        least = min((d is not None, d or 0) for d, t in rows if t and t.startswith(text))
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got if (r.text or "").startswith(text)] == [least]


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_samples_are_bounded_whatever_the_ids(spark, ids):
    from cleargrain.llm.texts import bounded_sample

    doc_id = {"null": F.lit(None).cast("long"), "one": F.lit(7).cast("long"), "own": F.col("id")}[ids]
    rows = spark.range(30_000).select(doc_id.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    copies = rows.unionByName(spark.range(15_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text")))
    assert bounded_sample(rows, 5_000, "any").count() == 5_000
    got = bounded_sample(copies, 5_000, "any")
    assert got.count() == 5_000 and got.filter("text = 'copy'").count() <= 1
    assert bounded_sample(copies, 50_000, "any").count() == 30_001
    assert bounded_sample(copies.filter("text = 'copy'"), 5_000, "any").count() == 1


def test_quality_with_null_ids_is_learned(spark):
    """All ids null, as many rows as make a sample: scores still differ."""
    docs = spark.read.parquet(f"{LEARN_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LEARN_DIR}/labels.parquet").select("doc_id", "quality")
    model, prior = quality.learn(docs.unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")), labels, sample=200)
    scores = [r.score for r in quality.score(docs.limit(200), model).collect()]
    assert 0 < prior < 1 and max(scores) - min(scores) > 0.5


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id", 4, 2).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
