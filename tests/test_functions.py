"""Worked examples for column functions and operators."""

from __future__ import annotations

import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairforge.functions import maths, rand, text, tokens as tk, vectors as vx
from pairforge.operators import batching, enrich, evaluate, normalise as nz, order, params, retrieval, sampling

E = tk.EOS


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def ints(spark, values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


@pytest.mark.parametrize(
    ("n", "pretrain", "sft", "sft_mask"),
    [
        (3, [1, 2, 3, E, 1, 2, 3, E], [0, 0, 0, E, 1, 2, 3, E], [False, True]),
        (5, [0, 1, 2, 3, E, 4, 5, E], [0, 1, 2, 3, E, 4, 5, E], [True, True]),
        (7, [2, 3, 4, E, 5, 6, 7, E], [2, 3, 4, E, 5, 6, 7, E], [True, True]),
        (10, [5, 6, 7, E, 8, 9, 10, E], [5, 6, 7, E, 8, 9, 10, E], [True, True]),
        (0, [0, 0, 0, 0, 0, 0, E, E], [0, 0, 0, 0, 0, 0, E, E], [False, False]),
    ],
)
def test_eos_chunks(spark, n, pretrain, sft, sft_mask):
    ids = ints(spark, range(1, n + 1))
    p, s = one(spark, tk.eos_pretrain(ids, 8, 4)), one(spark, tk.eos_sft(ids, 8, 4))
    assert p.ids == pretrain and p.eos_mask == [True, True]
    assert s.ids == sft and s.eos_mask == sft_mask


@pytest.mark.parametrize(
    ("n", "want"),
    [
        (3, [1, 2, 3, E, 1, 2, 3, E]), (5, [1, 2, 3, E, 4, 5, E]), (7, [1, 2, 3, 4, E, 5, 6, 7, E]),
        (10, [1, 2, 3, E, 4, 5, E, 6, 7, 8, E, 9, 10, E]), (0, [E, E]),
    ],
)
def test_eos_eval(spark, n, want):
    x = one(spark, tk.eos_eval(ints(spark, range(1, n + 1)), 8, 4))
    assert x.ids == want and len(x.eos_mask) == want.count(E)


def test_padding_and_windows(spark):
    assert one(spark, tk.left_pad(ints(spark, [1, 2]), 4)) == [0, 0, 1, 2]
    assert one(spark, tk.cross_encode(ints(spark, [1, 2, 3]), 3)) == [2, 3, E]
    assert one(spark, tk.cross_encode(ints(spark, []), 3)) == [0, 0, E]
    assert one(spark, tk.windows(ints(spark, range(5)), 2)) == [[0, 1], [2, 3], [4]]
    assert one(spark, tk.windows(ints(spark, []), 2)) == []
    p = one(spark, tk.batch_pad(ints(spark, [5, E]), F.array(F.lit(True)), F.lit(2), F.lit(5)))
    assert p.ids == [0, 0, E, 5, E] and p.eos_mask == [False, True]
    assert one(spark, tk.byte_ids(F.lit("hé"))) == [105, 196, 170]
    assert one(spark, tk.byte_ids(F.lit(None).cast("string"))) == []


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_trie_round_trip(s):
    v = tk.Vocabulary.bytewise(b"the", b"th", "é".encode())
    s = s.encode("utf-8", "replace").decode()
    assert v.decode(v.encode(s)) == s


def test_vocabulary():
    v = tk.Vocabulary.from_lines(["1 'a' 1", "2 'ab' 2", r"3 b'\xff' 1"], reserve_zero=True)
    assert v.encode("aba") == [2, 1] and v.decode([0]) == "<|endoftext|>" and v.decode([3]) == "�"
    with pytest.raises(ValueError):
        tk.Vocabulary.from_lines(["1 'a' 2"])
    with pytest.raises(ValueError):
        v.encode("b")
    with pytest.raises(UnicodeDecodeError):
        v.decode([3], "strict")


def test_text(spark):
    assert one(spark, text.parse_indices(F.lit("0, 5,-1"), F.lit(12))) == [0, 5, 11]
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, text.parse_indices(F.lit("12"), F.lit(12)))
    assert one(spark, text.fill_query(F.lit("a {x} {query}"), F.lit("q{query}"))) == "a {x} q{query}"
    assert one(spark, text.stem(F.lit("a/b.c.json"))) == "b.c"
    assert one(spark, text.percent_text(F.lit(None).cast("double"))) == "n/a"


def test_maths(spark):
    assert one(spark, maths.prime_3n2_below(F.lit(20))) == 17
    assert one(spark, maths.prime_3n2_below(F.lit(2))) is None
    assert [one(spark, maths.nearest_multiple(F.lit(x), 64)) for x in (96, 160, 10)] == [128, 128, 64]
    s = one(spark, maths.ivf_sizes(F.lit(500)))
    assert (s.lists, s.probes) == (22, 22)
    s = one(spark, maths.ivf_sizes(F.lit(10**9)))
    assert (s.lists, s.probes) == (4096, 32)
    assert retrieval.ivf_sizes(10**9) == (4096, 32)
    assert one(spark, evaluate.bce_with_logits(F.lit(0.0), F.lit(1.0))) == pytest.approx(math.log(2))


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(a)) for a in x])
    assert one(spark, vx.max_sim(F.array(v(1, 0), v(0, 1)), F.array(v(1, 0), v(0.5, 0.5)))) == 1.5
    assert one(spark, vx.l2_normalise(v(0, 0))) is None
    assert one(spark, vx.cosine(v(0, 0), v(1, 0))) is None
    assert one(spark, vx.euclidean(v(0, 3), v(4, 0))) == 5
    assert one(spark, vx.block_pool(F.array(v(2), v(4), v(6)), 2)) == [[1.0], [5.0]]
    assert one(spark, vx.masked_mean(F.array(v(2), v(4)), F.array(F.lit(False), F.lit(False)))) is None


def test_hash_is_duckdbs(spark, sf):
    import duckdb

    ours = {r.doc_id: r.h for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", rand.hash01(7, "é", "doc_id").alias("h")).collect()}
    theirs = dict(duckdb.sql(f"SELECT doc_id, {rand.sql_hash01(7, 'é', 'doc_id')} FROM '{sf}/documents.parquet'").fetchall())
    assert ours == theirs


SHAPES = [
    (["a", "b"], "Pairs", ("a", ["b"], [])), (["a", "p", "n"], "Triplets", ("a", ["p"], ["n"])), ({"set": ["x", "y", "z"]}, "Sets", ("x", ["y", "z"], [])),
    ({"query": "q", "pos": ["p1", "p2"]}, "Query-Pairs", ("q", ["p1", "p2"], [])), ({"query": "q", "pos": ["p"], "neg": ["n"]}, "Query-Triplets", ("q", ["p"], ["n"])),
    ({"query": "q", "pos": "p", "neg": "n"}, "Query-Pairs", ("q", ["p"], ["n"])), ({"set": ["x"]}, "Sets", None), ({"set": ["x", 3, "y"]}, "Sets", ("x", ["y"], [])),
    ({"query": "q", "set": ["x", "y"]}, "Sets", None), (["a"], None, None), (["a", "b", "c", "d"], None, None), ({"query": "", "pos": ["p"]}, "Query-Pairs", None),
    ({"query": None, "pos": ["p"]}, "Query-Pairs", None), ("text", None, None),
]


def test_shapes(spark):
    lines = [(i, json.dumps(x, ensure_ascii=i % 2 == 0)) for i, (x, _, _) in enumerate(SHAPES)]
    bad = [(100, "not json"), (101, ""), (102, "  "), (103, None)]
    df = spark.createDataFrame([(i, "f", s) for i, s in lines + bad], "i INT, file STRING, raw_line STRING")
    shapes = {r.i: r.s for r in df.select("i", nz.shape_of(nz.parsed(F.col("raw_line"))).alias("s")).collect()}
    recs = {r.i: (r.query, r.pos, r.neg) for r in nz.normalise(df).collect()}
    for i, (_, shape, rec) in enumerate(SHAPES):
        assert shapes[i] == shape and recs.get(i) == rec, SHAPES[i]
    assert not recs.keys() & {100, 101, 102, 103}
    assert nz.normalise(df, mode="quarantine").count() == df.count()
    assert [r.i for r in nz.quarantine(df).collect()] == [100]
    with pytest.raises(Exception, match="malformed"):
        nz.normalise(df, mode="fail").collect()
    texts = df.select("i", nz.all_texts(nz.parsed(F.col("raw_line"))).alias("t"))
    assert {r.i: r.t for r in texts.collect()}[13] == ["text"]


def test_filters(spark):
    df = spark.createDataFrame([("q", ["q", "r"], ["n"], None), ("q", ["p"], ["p", "q", "n", "n"], "[CLS]"), (None, None, None, "[STS]"), ("q", [], ["n"], None)], "query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, task STRING")
    assert df.filter(nz.query_not_positive()).count() == 3
    assert df.filter(nz.not_cls()).count() == 3
    assert df.filter(nz.valid_pair()).count() == 2
    assert df.select(nz.clean_negatives().alias("n")).collect()[1].n == ["n"]


def test_strict_lookup_names_the_key(spark):
    rows, m = spark.createDataFrame([("a",), ("z",)], "source STRING"), spark.createDataFrame([("a", "x")], "source STRING, tag STRING")
    with pytest.raises(Exception, match="no mapping for z"):
        enrich.add_from_map(rows, m, "source", "tag", "tag").collect()
    assert {r.source: r.tag for r in enrich.add_from_map(rows, m, "source", "tag", "tag", strict=False).collect()} == {"a": "x", "z": None}
    with pytest.raises(ValueError):
        enrich.filter_task_types(spark.createDataFrame([("t", "STS", 1.0)], "task_name STRING, task_type STRING, score DOUBLE"), ["Retrieval"])


def test_config_and_quotas(spark):
    c = sampling.sampling_config(spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000)], "file STRING, total_lines BIGINT")).orderBy("file").collect()
    assert [(r.sample_ratio, r.sampled_lines, r.dataset_share) for r in c] == [(1.0, 10, 0.048), (1.0, 100, 0.476), (0.1, 100, 0.476)]
    q = lambda est, cap: [r.quota for r in sampling.quotas(spark.createDataFrame([(str(i), e) for i, e in enumerate(est)], "file STRING, est DOUBLE"), cap).orderBy("file").collect()]
    assert q([33.0, 33.0, 34.0], 10) == [3, 3, 4] and q([1.0, 1.0, 1.0], 2) == [1, 1, 0]
    assert q([2.5, 3.5, None], 100) == [2, 4, None] and q([0.0, 0.0], 5) == [0, 0]


@given(st.lists(st.integers(0, 400), min_size=1, max_size=12), st.integers(1, 300))
@settings(max_examples=8, deadline=None)
def test_quotas_fill_the_cap(spark, est, cap):
    rows = spark.createDataFrame([(f"{i:02d}", float(e)) for i, e in enumerate(est)], "file STRING, est DOUBLE")
    assert sum(r.quota for r in sampling.quotas(rows, cap).collect()) == min(cap, sum(est))


def test_balanced_sizes(spark):
    rows = spark.createDataFrame([(f"d{k}", k * 1000 + i) for k, n in enumerate((1, 7, 30, 90)) for i in range(n)], "domain STRING, id BIGINT")
    sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    for strategy in ("range", "median", "probability"):
        targets = sampling.balance_targets(sizes, strategy, 8)
        got = {r.domain: r["count"] for r in sampling.resize(rows, targets, 1, "id").groupBy("domain").count().collect()}
        assert got == {r.domain: r.target for r in targets.collect()} and all(v % 8 == 0 for v in got.values())
    with pytest.raises(ValueError):
        sampling.balance_targets(sizes, "other", 8)


def test_shards(spark):
    rows = order.with_ordinal(spark.range(7).withColumnRenamed("id", "k"), "k")
    size = lambda c: [r["count"] for r in rows.groupBy(c.alias("s")).count().orderBy("s").collect()]
    assert size(order.contiguous_shard(F.col("ord0"), F.lit(7), 3)) == [2, 2, 3]
    assert size(order.stride_shard(F.col("ord0"), 3)) == [3, 2, 2]
    assert size(order.rolling_shard(F.col("ord0"), 3)) == [3, 3, 1]
    assert [r.ord0 for r in rows.orderBy("k").collect()] == list(range(7))


def test_chunks(spark):
    rows = spark.createDataFrame([("d", 1, "q1", ["p1"]), ("d", 2, "q2", ["p1"]), ("d", 3, "q3", ["p3"]), ("e", 4, None, None)], "domain STRING, ord BIGINT, query STRING, pos ARRAY<STRING>")
    got = batching.chunkify(rows, 2).orderBy("domain", "chunk_no", "place").collect()
    assert [(r.domain, r.chunk_no, r.ord) for r in got] == [("d", 0, 1), ("d", 0, 3), ("d", 1, 2), ("e", 0, 4)]


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6), st.lists(st.integers(0, 6), max_size=2)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_chunks_never_collide(spark, rows):
    df = spark.createDataFrame([(d, i, f"q{q}", [f"p{p}" for p in ps]) for i, (d, q, ps) in enumerate(rows)], "domain STRING, ord BIGINT, query STRING, pos ARRAY<STRING>")
    got = batching.chunkify(df, 4).collect()
    assert sorted(r.ord for r in got) == list(range(len(rows)))
    chunks: dict = {}
    for r in got:
        chunks.setdefault((r.domain, r.chunk_no), []).append(rows[r.ord])
    for c in chunks.values():
        assert len(c) <= 4 and len({q for _, q, _ in c}) == len(c)
        seen = [p for _, _, ps in c for p in set(ps)]
        assert len(seen) == len(set(seen))


def test_round_robin(spark):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate("aaab")] + [("e", 10, None)], "domain STRING, ord BIGINT, label STRING")
    got = batching.round_robin_groups(df).collect()
    assert sorted(r.ord for r in got) == [0, 3]


@given(st.dictionaries(st.integers(1, 9), st.integers(1, 40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_bins_are_full(histogram):
    size, fill, used = 8, {}, {}
    for length, first, last, bin_, each in batching.plan_bins(histogram, size):
        for g in range(first, last):
            assert (length, g) not in used
            used[length, g] = 1
            fill[bin_ + (g - first) // each] = fill.get(bin_ + (g - first) // each, 0) + length
    assert set(fill.values()) <= {size}


def test_packing_example(spark):
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate([4, 3, 2, 1, 2])], "group_id STRING, len INT")
    packed = batching.pack_groups(df, 4)
    assert sorted(sorted(r.x) for r in packed.groupBy("bin").agg(F.collect_list("len").alias("x")).collect()) == [[1, 3], [2, 2], [4]]
    assert batching.bin_statistics(packed).first().asDict() == {"bins": 3, "avg": 4.0, "max": 4, "min": 4, "var": 0.0}


def test_macro(spark):
    s = spark.createDataFrame([("A", "CLS", 0.8), ("B", "CLS", 0.6), ("C", "STS", 0.9)], "task_name STRING, task_type STRING, score DOUBLE")
    assert {(r.level, r.name): r.score for r in evaluate.macro_averages(s).collect()} == {("type", "CLS"): 0.7, ("type", "STS"): 0.9, ("mean", "tasks"): 0.766667, ("mean", "types"): 0.8}


def test_params(spark):
    p = spark.createDataFrame([("c", k, [1], [1.0]) for k in ("blocks.0.att.w", "blocks.1.att.w", "head.w")], "ckpt STRING, key STRING, shape ARRAY<INT>, vals ARRAY<DOUBLE>")
    assert {r.name for r in params.compress_names(p).collect()} == {"blocks.{0,1}.att.w", "head.w"}
    k = F.lit("model.core.blocks.0.x")
    assert one(spark, params.segment_suffix(k, "core")) == "blocks.0.x" and one(spark, params.prefix_suffix(k, "core")) is None
    with pytest.raises(ValueError):
        params.extract(p, "none")
    with pytest.raises(KeyError):
        params.nested(p, key="none")
    assert params.nested(p).count() == 3
    assert {r.key for r in params.remap_blocks(p, [1]).collect()} == {"blocks.0.att.w", "head.w"}


def test_mined_negatives_are_none(spark):
    q = spark.createDataFrame([], "query_id BIGINT, vector ARRAY<FLOAT>, label INT")
    c = spark.createDataFrame([(1, [1.0, 0.0], 0)], "id BIGINT, vector ARRAY<FLOAT>, label INT")
    assert retrieval.mine(q, c).count() == 0
    assert retrieval.knn_exact(c.withColumnRenamed("id", "query_id"), c, 3).count() == 0


def test_blocks_of_queries_agree(spark, sf):
    c = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = c.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r.id, r["rank"]) for r in df.collect())
    assert key(retrieval.knn_exact(q, c, 5, block=3)) == key(retrieval.knn_exact(q, c, 5))


def test_state_fold_in_pieces(spark):
    step = lambda s, t: s * 0.5 + t
    df = spark.createDataFrame([(1, [1, 2, 3])], "id BIGINT, ids ARRAY<INT>")
    assert retrieval.fold_states(df, step, 1).first().state == [0.5 * (0.5 * 1 + 2) + 3]


def test_ranking_head(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    hidden, out, gain, bias = rng.normal(size=(3, 4)), rng.normal(size=3), rng.normal(size=4), rng.normal(size=4)
    x = rng.normal(size=4)
    df = spark.createDataFrame([(x.tolist(),)], "f ARRAY<DOUBLE>").select(retrieval.ranking_head(hidden, out, gain, bias)("f").alias("s"))
    n = (x - x.mean()) / np.sqrt(x.var() + 1e-5) * gain + bias
    assert df.first().s == pytest.approx(float(np.maximum(hidden @ n, 0) @ out))


def test_instructions(spark):
    from pairforge.functions.instructions import BENCHMARKS, alias, benchmark

    assert len({alias(b) for b in BENCHMARKS}) == 43 and benchmark("mteb_eng_v2") == "MTEB(eng, v2)" and alias("BRIGHT (long)") == "BRIGHT_LONG"
    with pytest.raises(ValueError):
        benchmark("none")
    tasks = spark.createDataFrame([("Banking77Classification.v2", "Classification"), ("x", "STS"), ("x", "Other")], "task_name STRING, task_type STRING")
    got = [r.instruction for r in enrich.task_instruction(tasks).collect()]
    assert got[0].startswith("Instruct: Given a online banking query") and got[1] == "Instruct: Retrieve semantically similar text\nQuery: {query}" and got[2] == ""


def test_places_in_hot_groups(spark):
    rows = [("hot" if i % 2 else f"g{i % 10}", i * 7 % 1000, i) for i in range(1000)] + [(None, 5, 2000), (None, 5, 1999)]
    df = spark.createDataFrame(rows, "g STRING, k BIGINT, id BIGINT")
    want = {}
    for g in {g for g, _, _ in rows}:
        for place, (_, i) in enumerate(sorted((k, i) for h, k, i in rows if h == g)):
            want[i] = place
    assert {r.id: r.place for r in order.place_in_group(df, ["g"], "k", ["id"]).collect()} == want
    few = df.filter("g <> 'hot'")
    assert {r.id for r in order.place_in_group(few.filter("id < 3"), ["id"], "k", ["id"]).filter("place = 0").collect()} == {0, 2}
    assert order.place_in_group(df.limit(0), ["g"], "k", ["id"]).count() == 0


def test_hot_join(spark):
    from pairforge.operators.skew import hot_join

    left = spark.range(1000).select((F.col("id") % 3 * F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert sorted(map(tuple, hot_join(left, right, "k").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert hot_join(left.limit(0), right, "k").count() == 0
