"""The pipeline's stages: each against brute force on what its predecessor kept."""

import collections
import struct

import public_tokenizers as P

import corpus_pipeline
from panelrisk.llm import quality_rules
from test_text_operators import fingerprint_brute, groups_brute, lines_brute, sha, without_repeats


def test_stages_and_run(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "sequences":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.select("n_chars", "text").collect())
            results[name] = (dict(before), {r.doc_id: r.text for r in docs.collect()})

    before, kept = results["quality"]
    judged = quality_rules.score_quality(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in judged.filter("kept").collect()}
    assert 0 < len(kept) < len(before)

    before, kept = results["lines"]
    assert {i: sha(t) for i, t in kept.items()} == {i: s for i, _, _, s in lines_brute(before.items())}

    before, kept = results["near_copies"]
    ids = sorted(before)
    groups = groups_brute([fingerprint_brute(before[i]) for i in ids])
    assert set(kept) == {ids[g] for g in groups} and all(kept[i] == before[i] for i in kept)

    before, kept = results["passages"]
    want = {r[0]: r for r in without_repeats(before.items())}
    assert set(kept) == set(before)
    for i, t in kept.items():
        if want[i][2] == 0:
            assert t == before[i]
        else:
            assert len(t.encode()) <= want[i][1] - want[i][2]

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(kept)
    for i, t in kept.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        for r in pieces[i]:
            own = ids[r.start:r.start + r.length]
            assert struct.pack(f"<{len(own)}I", *own) == bytes(r.ids)
        assert sum(r.length for r in pieces[i]) == len(ids)
    places = collections.defaultdict(list)
    for own in pieces.values():
        for r in own:
            places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():  # without gaps from 0, and no longer than a sequence
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k])
                                               for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024

    whole = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(whole.select(*cols).collect()) == sorted(docs.select(*cols).collect())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Missing texts, one document only, nothing at all."""
    good = " ".join(f"word{i}" for i in range(60))
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([(1, None, None, None, None), (2, good, "en", "s", 5)], [])):
        folder = tmp_path / f"case{k}"
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int") \
            .write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert [r.doc_id for r in got] == [r[0] for r in rows if r[1]]


def test_pipeline_on_missing_and_repeated_ids(spark, tmp_path):
    """Rows are told apart by more than their doc_id, from the first stage to the last."""
    a, b, c, d = (" ".join(f"{k}{i * i}" for i in range(80)) for k in "abcd")
    shared = " " + " ".join(f"shared{i}" for i in range(20))
    rows = [(None, a + shared, "en", "s0", None), (None, d, "en", "s5", None),
            (7, b, "en", "s1", 1), (7, c + shared, "fr", "s2", 2),
            (7, (c + shared).upper(), "de", "s3", 3), (7, b, "en", "s1", 1), (3, d + shared, "en", "s4", 4)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = spark.read.parquet(f"{tmp_path}/passages").collect()
    # the row in capitals comes first of its group; shared stays in the row without a doc_id
    first = {"s0": a + shared, "s5": d, "s1": b, "s3": (c + shared).upper(), "s4": ""}
    assert sorted((str(r.doc_id), r.source, r.lang, r.text, r.n_chars) for r in kept) == sorted(
        (str(i), s, lang, first[s], len(first[s]))
        for i, lang, s in ((None, "en", "s0"), (None, "en", "s5"), (7, "en", "s1"), (7, "de", "s3"),
                           (3, "en", "s4")))
    heads = [str(r.doc_id) for r in docs.filter("piece = 0").collect()]
    assert sorted(heads) == ["3", "7", "7", "None", "None"]
    columns = ["doc_id", "piece", "start", "length", "ids"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.select(*columns).collect()))


CLASHES = ["_row", "_kept", "kept", "llr", "_text", "_t", "_lines", "_d", "_drop", "n_lines",
           "kept_text", "_words", "_h", "_g", "_s", "_at", "_p", "_r", "carried", "row", "fp",
           "component_id", "spans", "n_words", "h1", "th", "drop", "id", "given", "_id", "b", "hit"]


def test_stages_carry_columns_of_any_name(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " \
        + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *(r.doc_id * 100 + k for k in range(len(CLASHES))))
                                  for r in rows], ddl)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert found and all(tuple(r)[5:] == tuple(r.doc_id * 100 + k for k in range(len(CLASHES)))
                             for r in found), name
        assert sorted(map(str, got.select(*plain.columns).collect())) \
            == sorted(map(str, stage(spark, plain, sf).collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns == [
        "doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def test_run_leaves_the_last_copy_only(spark, sf):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("sequences-")
    assert got.count() > 0
