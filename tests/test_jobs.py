"""Jobs and operators beyond their registered queries: brute force and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge import jobs
from pairforge.operators import order, params, retrieval, sampling, texts
from pairforge.sources import jsonl

RECORDS = "rec_id BIGINT, query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, source STRING"


@pytest.mark.parametrize("topk", [None, 3])
def test_mined_texts_against_brute_force(spark, topk):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice(words, 6))
    data = [(i, text(), [text() for _ in range(rng.integers(1, 3))], [text()] if i % 3 else None, "s") for i in range(60)]
    data += [(60, "same", ["same", "x"], [], "s"), (61, None, ["y"], [], "s"), (62, "z", None, [], "s"), (63, "full", ["w1 w2"], ["a", "b", "c", "d", "e"], "s")]
    got = {r.rec_id: r for r in jobs.mine_texts(spark.createDataFrame(data, RECORDS), lo=1, hi=12, negative_number=4, filter_topk=topk).collect()}
    enc = retrieval.HashEncoder().encode
    own = [d for d in data if d[1] is not None and d[2] and d[1] not in d[2]]
    corpus = sorted({t for d in own for t in [*d[2], *(d[3] or [])]})
    vec = {t: v.astype(np.float64) for t, v in zip(corpus, enc(corpus))}
    want = {}
    for rid, q, pos, neg, _ in own:
        neg, qv = neg or [], enc([q])[0].astype(np.float64)
        dist = {t: np.sqrt(((vec[t] - qv) ** 2).sum()) for t in corpus}
        ranked = sorted(dist.values())
        if len(neg) < 4 and topk is not None and np.floor(min(dist[p] for p in pos) * 1e9) > np.floor(ranked[topk] * 1e9):
            continue
        want[rid] = (neg, dist, ranked, pos, q)
    assert set(got) == set(want)
    for rid, (neg, dist, ranked, pos, q) in want.items():
        r = got[rid]
        assert r.neg[: len(neg)] == neg and len(r.neg) <= max(4, len(neg)) and len(set(r.neg[len(neg) :])) == len(r.neg) - len(neg)
        for t in r.neg[len(neg) :]:  # at places 1..11
            assert t not in pos and t != q and ranked[1] - 1e-9 <= dist[t] <= ranked[11] + 1e-9


def test_mining_shuffles_no_candidates(spark):
    """From inverted lists too: the plan after the corpus is written is one pass over the records."""
    data = [(i, f"a{i} b{i % 7} c{i % 11}", [f"b{i % 5} c{i} d{i % 3}"], [], "s") for i in range(300)]
    mined = jobs.mine_texts(spark.createDataFrame(data, RECORDS), lo=1, hi=12, negative_number=4, exact_pairs=0)
    plan = mined._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "FlatMapCoGroups", "Join")) and plan.count("Exchange") <= 1  # the records, dealt out
    assert {len(set(r.neg)) for r in mined.collect()} == {4}


def test_neighbours_are_exact_at_any_size(spark):
    """More than ten million pairs: all records have the negatives that brute force over the whole corpus finds."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 6))
    data = [(i, text(), [text(), text()], [], "s") for i in range(2500)]
    got = {r.rec_id: r.neg for r in jobs.mine_texts(spark.createDataFrame(data, RECORDS), lo=0, hi=12, negative_number=12).collect()}
    enc, corpus = retrieval.HashEncoder().encode, sorted({t for d in data for t in d[2]})
    assert len(got) == len(data) and len(corpus) * len(data) > 10_000_000
    own, x, q = texts.keys_of(corpus), enc(corpus), enc([d[1] for d in data])
    for i, query, pos, _, _ in data:
        d = texts.distances(np.repeat(q[i][None], len(x), axis=0), x)
        best = np.lexsort((own, np.floor(d * 1e9)))[:12]
        assert set(got[i]) == {corpus[j] for j in best} - {query, *pos}


@pytest.mark.parametrize("lists", [1, 9])
def test_search_in_files_against_brute_force(spark, lists, tmp_path, monkeypatch):
    """Through first bounds, several groups and pieces; equal texts' ties by key; a bound that is too low is noticed."""
    monkeypatch.setattr(texts, "GROUP_BYTES", 700 * 32)
    monkeypatch.setattr(texts, "TILE", 5000)
    monkeypatch.setattr(texts, "ivf_sizes", lambda n: (lists, 4))
    rng = np.random.default_rng(3)
    said = [" ".join(f"w{x}" for x in rng.integers(0, 60, 4)) for _ in range(4000)]
    enc = retrieval.HashEncoder(8)
    corpus = texts.TextLists(spark.createDataFrame([(t,) for t in said], "text STRING"), str(tmp_path / "c"), enc, "", 1, 0)
    assert corpus.n == len(set(said))
    queries = enc.encode([" ".join(f"w{x}" for x in rng.integers(0, 60, 3)) for _ in range(200)])
    centres = corpus.centres if lists > 1 else None
    dist, key, row = texts.search(queries, corpus.files, corpus.lists if lists > 1 else None, centres, min(lists, 4), corpus.n, 20)
    once = sorted(set(said))
    own, x = texts.keys_of(once), enc.encode(once)
    at = np.zeros(len(x), dtype=int) if centres is None else texts.nearest_centres(x, centres, 1)[:, 0]
    near = np.zeros((len(queries), 1)) if centres is None else texts.nearest_centres(queries, centres, 4)
    for i, q in enumerate(queries):
        c = np.flatnonzero(np.isin(at, near[i]))
        d = texts.distances(np.repeat(q[None], len(c), axis=0), x[c])
        best = np.lexsort((own[c], np.floor(d * 1e9)))[:20]
        assert key[i].tolist() == own[c][best].tolist() and np.allclose(dist[i], d[best])
    places, back = np.unique(row, return_inverse=True)
    assert texts.keys_of(texts._texts_at(corpus.files, places).take(back.ravel()).to_pylist()).tolist() == key.ravel().tolist()


def test_search_in_blocks_equals_one_block(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.withColumnRenamed("id", "query_id").filter("query_id % 3 = 0")
    whole, parts = (sorted(tuple(r) for r in retrieval.knn_exact(q, e, 5, block=b).collect()) for b in (10_000, 7))
    assert [(a, b, d) for a, b, _, d in whole] == [(a, b, d) for a, b, _, d in parts]
    one, more = (sorted(tuple(r) for r in retrieval.mine(q, e, lo=1, hi=8, negatives=3, filter_topk=5, block=b).select("query_id", "id", "rank").collect()) for b in (10_000, 7))
    assert one == more
    assert retrieval.knn_exact(q.limit(0), e, 5).count() == 0


def test_places_in_a_bunched_hot_group(spark):
    """A group of nine tenths of the rows whose values bunch up at one end."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("v"))
    rows = rows.unionAll(spark.createDataFrame([(None, 5), (None, 3)], "g STRING, v BIGINT"))
    got = order.place_in_group(rows, ["g"], "v", [])
    want = rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY g ORDER BY v) - 1"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    sizes = order.number_buckets(rows, "v").groupBy("_b").count().collect()
    assert max(r["count"] for r in sizes) < 2 * 4002 / 4 + 10


@pytest.mark.parametrize("k", [0, 1, 50, 10_000])
def test_bottom_k(spark, k):
    from pairforge.functions.rand import det_key

    got = [r.id for r in order.bottom_k(spark.range(3000), 5, "id", k, name="place").orderBy("place").collect()]
    assert got == [r.id for r in spark.range(3000).orderBy(det_key(5, "pool", "id"), "id").limit(k).collect()]


def test_resize_keeps_null_groups(spark):
    rows = spark.createDataFrame([(i, None if i < 5 else "a") for i in range(30)], "id BIGINT, domain STRING")
    targets = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.lit(12).cast("bigint"))
    got = sampling.resize(rows, targets, 1, "id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).collect()
    assert sorted(map(tuple, got)) == [("a", 12, 12), ("unknown", 12, 5)]


def test_lines_of_a_plain_file_in_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"{i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        assert all(r.line_no == int(r.line) for r in jsonl.number_lines(lines).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_recurrence_of_uneven_rows(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=(i % 4, 12)).tolist(), None if i % 2 else rng.normal(size=4).tolist()) for i in range(9)]
    got = {r.id: r for r in retrieval.recur(spark.createDataFrame(data, "id BIGINT, steps ARRAY<ARRAY<DOUBLE>>, state ARRAY<DOUBLE>"), 2).collect()}
    for i, steps, state in data:
        s, out = np.zeros((2, 2)) if state is None else np.array(state).reshape(2, 2), []
        for step in steps:
            r, w, k, v, a, b = np.array(step).reshape(6, 2)
            s = s * np.exp(-np.exp(w))[None, :] + np.outer(s @ a, b) + np.outer(v, k)
            out += (s @ r).tolist()
        assert np.allclose(got[i].outputs, out) and np.allclose(got[i].state, s.ravel())


def test_job_edges(spark, tmp_path):
    empty = spark.createDataFrame([], RECORDS)
    assert jobs.domain_chunks(empty).count() == 0 and jobs.mine_texts(empty).count() == 0
    (tmp_path / "a.jsonl").write_text("[]\n")
    (tmp_path / "c.csv").write_text("file,total_lines,sample_ratio,sampled_lines,dataset_share\na.jsonl,1,1.0,1,1.0\n")
    with pytest.raises(RuntimeError, match="no samples"):
        jobs.sample_datasets(spark, str(tmp_path), str(tmp_path / "c.csv"))
    (tmp_path / "m.json").write_text('{"a": "x"}')
    jsonl.write_records(spark.createDataFrame([("q", ["p"], None, "b")], jobs.RECORD), str(tmp_path / "r"))
    with pytest.raises(Exception, match="no mapping for b"):
        jobs.add_from_mapping(spark, str(tmp_path / "r"), None, str(tmp_path / "m.json")).collect()
    jobs.distribute(spark, str(tmp_path / "r"), str(tmp_path / "out"), 2)
    assert (tmp_path / "r").exists()  # inputs stay unless told otherwise


def test_keys_of_parameters(spark):
    rows = spark.createDataFrame([("params.a", [1], [1.0]), ("model.b", [1], [1.0])], "key STRING, shape ARRAY<INT>, vals ARRAY<DOUBLE>")
    assert [r.key for r in params.nested(rows).collect()] == ["b"]
    with pytest.raises(KeyError):
        params.nested(rows, key="weights")
    assert [r.trainable for r in params.freeze(rows.withColumn("key", F.lit("proj.w")), 0, 4, proj=True).collect()] == [False, False]


def test_pair_scores_of_nulls(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "x"), ("x", None), ("", "")], "query STRING, text STRING")
    assert [None if r.score is None else round(r.score, 4) for r in retrieval.predict_pairs(rows, batch=2).collect()] == [0.3333, None, None, 0.0]


def test_chunks_of_a_hot_domain_in_runs(spark):
    """A domain of more than split_rows rows is chunked run by run; the same rule leaves a smaller one whole."""
    from pairforge.operators import batching

    rows = spark.range(95).select(F.lit("d").alias("domain"), (F.col("id") * 3).alias("ord"), F.concat(F.lit("q"), F.col("id") % 60).alias("query"), F.array(F.concat(F.lit("p"), "id")).alias("pos"))
    got = batching.chunkify(rows, size=8, split_rows=40).collect()
    assert sorted(r.ord for r in got) == [i * 3 for i in range(95)] and {r.part for r in got} == {0, 1, 2}
    for part in range(3):
        own = rows.filter((F.col("ord") >= part * 120) & (F.col("ord") < part * 120 + 120))
        alone = batching.chunkify(own, size=8)
        assert sorted((r.chunk_no, r.place, r.ord) for r in got if r.part == part) == sorted((r.chunk_no, r.place, r.ord) for r in alone.collect())
