"""The operators for training data: twins, brute force, invariants, and the stated edge cases."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairforge.llm import bpe, copies, leaks, mixing, neighbours, packing, pairs, splitting
from pairforge.llm.queries import LLM

RECORD = "rec_id BIGINT, query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, source STRING"
#: Columns that no operator may trip over.
CLASHING = ["key", "id", "n", "n_copies", "first_id", "bin", "salt", "class", "cls", "home", "rank", "length", "word", "ids", "matched", "piece_no"]


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.mark.parametrize("name", LLM.oracles)
def test_equals_duckdb(name, check):
    check(LLM.runs[name], LLM.oracles[name])


@pytest.mark.parametrize("name", [n for n in LLM.runs if n not in LLM.oracles])
def test_gives_rows(name, spark, sf):
    assert LLM.runs[name](spark, sf).count() > 0


def test_columns(spark, sf):
    want = {"p1_found": ["rec_a", "rec_b"], "p2_found": ["rec_id", "side", "item_no", "defect"], "p3_found": ["vec_a", "vec_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"]}
    for name, columns in want.items():
        df = LLM.runs[name](spark, sf)
        assert df.columns == columns
        assert all(t in ("bigint", "string", "array<int>") for _, t in df.dtypes)


# 1. Copies


def brute_key(query, pos):
    def strip(s):
        kept = (c for c in s if not (c.isspace() or unicodedata.category(c)[0] in "PZ" or c in "᠎​‌‍⁠﻿"))
        return "".join(kept).casefold()

    q = strip(query or "")
    p = [x for x in (strip(x) for x in pos or [] if x is not None) if x]
    return tuple(sorted([q, *p])) if q and p else None


COPIES = [
    (1, "How, so?", ["Like this."]), (2, "like THIS", ["how​so"]), (3, "How so", ["Like this", ""]), (4, "How so", ["Like this", "Like this"]),
    (5, "How so", ["like", "this"]), (6, None, ["a"]), (7, None, ["a"]), (8, "a", None), (9, "a", []), (10, "a", [None, " "]), (11, "...", ["b"]),
    (12, "Straße", ["x"]), (13, "STRASSE", ["X!"]), (14, "a+b", ["c"]), (15, "ab", ["c"]), (16, "x" * 200_000, ["y"]), (17, "X" * 200_000, ["y"]), (18, "", ["a"]),
]


def test_copies_edge_cases(spark):
    df = with_clashes(spark.createDataFrame([(i, q, p, None, None) for i, q, p in COPIES], RECORD))
    assert rows(copies.find_copies(df)) == [(1, 2), (1, 3), (12, 13), (16, 17)]
    got = dict(rows(copies.collapse(df)))
    assert got[1] == 3 and got[6] == 1 and sum(got.values()) == len(COPIES)
    none = spark.createDataFrame([], RECORD)
    assert rows(copies.find_copies(none)) == [] and rows(copies.collapse(none)) == []


@given(st.lists(st.tuples(st.sampled_from(["a b", "A-B", "ab", "c", "", None, "é"]), st.one_of(st.none(), st.lists(st.sampled_from(["x", "X.", "y", None, " "]), max_size=3))), max_size=30))
@settings(max_examples=5, deadline=None)
def test_copies_against_brute_force(spark, data):
    groups = defaultdict(list)
    for i, (q, p) in enumerate(data):
        if (k := brute_key(q, p)) is not None:
            groups[k].append(i)
    want = sorted(((g[0], x) for g in groups.values() for x in g[1:]), key=repr)
    assert rows(copies.find_copies(spark.createDataFrame([(i, q, p, None, None) for i, (q, p) in enumerate(data)], RECORD), batches=2)) == want


def test_hot_key_goes_by_broadcast(spark):
    df = spark.range(900).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.expr("id div 6"))).alias("query"), F.array(F.lit("p")).alias("pos"))
    want = defaultdict(list)
    for i in range(900):
        want["hot" if i % 3 == 0 else i // 6].append(i)
    assert rows(copies.find_copies(df)) == sorted(((g[0], x) for g in want.values() for x in g[1:]), key=repr)


def test_ledger_keeps_the_earliest(spark, tmp_path):
    key = lambda s: s.encode()
    ledger = copies.CopyLedger(spark, str(tmp_path / "l"), buckets=3)
    for batch in ([(5, key("a")), (6, key("b")), (7, None)], [(3, key("a")), (9, key("c")), (9, key("c"))], []):
        ledger.merge(spark.createDataFrame(batch, "id BIGINT, key BINARY"))
    assert {bytes(r.key): (r.n_copies, r.first_id) for r in ledger.table.collect()} == {b"a": (2, 3), b"b": (1, 6), b"c": (2, 9)}


# 2. Pairs

MODEL_TEXTS = ["The pump needs oil because the surface is uneven. Move the valve after a few weeks. It rests on the bench when the air is dry."] * 200 + ["- first the pump\n- then the valve"] * 20


@pytest.fixture(scope="module")
def model():
    return pairs.EndModel(MODEL_TEXTS, ["A guide to the pump", "Why is the valve dry?"] * 40)


@pytest.mark.parametrize(
    ("query", "entry", "defect"),
    [
        ("Why is it wet?", None, "empty"), ("Why is it wet?", "  ​", "empty"), ("Why is it wet?", "N/A", "empty"), ("Why is it wet?", "[deleted]", "empty"), ("Why is it wet?", "<p></p>", "empty"),
        ("Why is it wet?", "(leer)", "empty"), ("Why is it wet?", "...", "empty"), ("怎么办？", "无", "empty"), ("Why is it wet?", "Answer:", "empty"),
        ("Why is it wet?", "0", None), ("Why is it wet?", "Nil.", None), ("Why is it wet?", "not yet", None), ("Why is it wet?", "Yes", None), ("怎么办？", "不用。", None),
        ("Why is it wet?", "I'm sorry, but I can't help with that request.", "refusal"), ("Why is it wet?", "Unfortunately, I have to pass on this one. Is there anything else you would like to know?", "refusal"),
        ("Warum?", "Leider kann ich diese Frage nicht beantworten. Bitte wenden Sie sich an eine Fachkraft.", "refusal"), ("怎么办？", "很抱歉，我无法回答这个问题。您还有其他问题吗？", "refusal"),
        ("Why is it wet?", "I was sorry to read that. Move the valve after a few weeks.", None), ("Why is it wet?", "I can't recommend the pump enough. Move the valve after a few weeks.", None),
        ("Why is it wet?", "I am unable to see your setup from here; even so, the usual cure is simple. Move the valve after a few weeks.", None),
        ("Why is the pump wet today?", "WHY IS THE PUMP WET TODAY", "copy"), ("Why is the pump wet today?", "> Why is  the pump wet today? Why is the pump wet today?", "copy"),
        ("Why is the pump wet today?", "You asked: Why is the pump wet today?", "copy"), ("怎样清洗水龙头？", "关于“怎样清洗水龙头？”：", "copy"),
        ("Why is the pump wet today?", "You ask: Why is the pump wet today? Short answer: Move the valve after a few weeks.", None), ("Why is the pump wet today?", "The pump is wet today.", None),
        ("Why is the pump wet today?", "Die Pumpe ist nass, weil das Wasser nicht abläuft.", "language"), ("Pourquoi la pompe est-elle humide ?", "先修理阀门，再去清洗水龙头。", "language"),
        ("Translate into German: The pump is wet.", "Die Pumpe ist nass und das Wasser ist kalt.", None), ("Translate into German: The pump is wet.", "Il ne faut pas régler la pompe avant la fin.", "language"),
        ("Why is the pump wet today?", "def pump(x, limit=3):\n    return x[:limit]", None), ("Why is the pump wet today?", "The label reads “à conserver au sec” on the pump.", None),
        ("Why is the pump wet today?", "Move the valve after a few weeks. It rests on the", "truncated"), ("Why is the pump wet today?", "Move the valve after a few weeks, because", "truncated"),
        ("Why is the pump wet today?", "Move the valve after a few weeks. It rests on the ...", "truncated"), ("Why is the pump wet today?", "Move the valve (see the", "truncated"),
        ("Why is the pump wet today?", "def pump(x, limit=3):\n    return x[:", "truncated"), ("Why is the pump wet today?", "Move the valve after a few weeks,", "truncated"),
        ("Why is the pump wet today?", "Move the valve after a few weeks", None), ("Why is the pump wet today?", "Move the valve after a few weeks. etc.", None), ("Why is the pump wet today?", "- first the pump\n- then the valve", None),
        ("Why is the pump wet today?", "“Move the valve after a few weeks.” [2]", None), ("Why is the pump wet today?", "**Move the valve after a few weeks.** 🙂", None),
        ("Why is the pump wet today?", "Move the valve after a few weeks. " * 3000, None),
    ],
)
def test_defects(model, query, entry, defect):
    import pandas as pd

    df = pd.DataFrame({"rec_id": [1], "query": [query], "pos": [[entry]], "neg": [None], "cls": [False]})
    got = [d for out in pairs._judge(model)(iter([df])) for d in out["defect"]]
    assert got == ([defect] if defect else [])


def test_defects_of_records(spark):
    tasks = spark.createDataFrame([("c", "[CLS]"), ("r", "[RETR]"), (None, "[CLS]")], "source STRING, tag STRING")
    data = [
        (1, None, ["n/a"], None, "r"), (2, " ​", ["n/a"], None, "r"), (3, "q", None, None, "r"), (4, "q", [], [None], "r"), (5, "Why is the pump wet?", ["Why is the pump wet?"], ["null"], "c"),
        (6, "Why is the pump wet?", ["Why is the pump wet?"], None, "unknown"), (6, "Why is the pump wet?", ["Why is the pump wet?"], None, None),
    ]
    got = rows(pairs.find_defects(with_clashes(spark.createDataFrame(data, RECORD)), tasks))
    assert got == sorted([(3, "pos", 0, "empty"), (4, "pos", 0, "empty"), (4, "neg", 0, "empty"), (5, "neg", 0, "empty"), (6, "pos", 0, "copy"), (6, "pos", 0, "copy")], key=repr)
    assert rows(pairs.find_defects(spark.createDataFrame([], RECORD), tasks)) == []


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
@settings(max_examples=300, deadline=None)
def test_suffix_automaton(query, entry):
    q = "".join(query)
    for i, (n, end) in enumerate(pairs.SuffixAutomaton(query).run(entry)):
        want = max(k for k in range(i + 2) if "".join(entry[i + 1 - k : i + 1]) in q)
        assert n == want and (n == 0 or q[end - n : end] == "".join(entry[i + 1 - n : i + 1]))


def test_ends_are_counted_in_all_records(spark, monkeypatch):
    """In pieces they are what the whole gives at once; of more records every one counts, stated for PER_ROWS."""
    texts = [f"The pump {i % 7} needs oil, as the {w} is dry. Move the {w}, then the valve because {w}" for i in range(40) for w in ("bench", "surface", "lid", f"name{i}")]
    data = [(i, f"A guide to the {t[:12]}" if i % 3 else None, [t, None], ["not yet"] if i % 2 else None, "s") for i, t in enumerate(texts)]
    records = spark.createDataFrame(data, RECORD).repartition(5)
    own = pairs.EndModel([t for d in data for t in [d[2][0], *(d[3] or [])]], [d[1] for d in data if d[1]])
    monkeypatch.setattr(pairs, "PIECE", 500)
    got = pairs.fit_ends(records)
    for part in ("known", "seen", "prefixes", "whole", "stats", "last_pairs", "after"):
        assert getattr(got, part) == getattr(own, part), part
    monkeypatch.setattr(pairs, "PER_ROWS", 20)
    few = pairs.fit_ends(records)
    assert few.stats["pump"] == (own.stats["pump"][0] / 8, 0) and few.stats["valve because"][0] * 8 == own.stats.get("valve because", (0, 0))[0]
    assert len(few.stats) < len(own.stats) and all(own.stats[c] == (n * 8, e * 8) for c, (n, e) in few.stats.items())


def test_ends_are_counted_in_little_memory():
    """Texts are handed on in small rows; a piece takes few bytes a word, and what is frequent in it is what brute force finds."""
    import tracemalloc

    import pandas as pd

    words = np.random.default_rng(4).zipf(1.3, (4_000, 100)).clip(0, 3_000)
    batch = pd.DataFrame({"query": None, "texts": [[" ".join(f"w{i}" for i in t)] for t in words.tolist()]})
    parts = pd.concat(list(pairs._words(iter([batch]))))
    parts = parts[parts["kind"] == "a"]
    sizes = [len(x) for c in set(parts) - {"kind", "word", "n"} for x in parts[c]]
    assert parts["n"].sum() == len(words) and max(sizes) < 1 << 19  # with regions of 1 MB, the JVM's large objects begin there
    names = ["#", "§", *(f"w{i}" for i in range(200))]
    own = sorted((pairs._hash(w), i) for i, w in enumerate(names) if i != 1)
    tracemalloc.start()
    found = list(pairs._frequent(iter([parts]), np.array([h for h, _ in own]), np.array([i for _, i in own]), 1, 50 / len(words)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * words.size, peak / words.size
    seen: Counter = Counter()
    for t in np.where(words < 200, words + 2, 1).tolist():
        seen.update(tuple(t[end - k : end]) for end in range(1, len(t)) for k in range(1, min(pairs.CONTEXT, end) + 1))
    want = {c for c, n in seen.items() if n >= (50 if len(c) == 2 and seen[c[1:]] >= 300 else 300)}
    got = [tuple(np.frombuffer(x, dtype=np.int32).tolist()) for out in found for x in out["ids"]]
    assert len(got) == len(want) and set(got) == want and {len(c) for c in want} == {1, 2, 3, 4, 5}


@given(st.text(st.sampled_from("aZ9_ .-'é\u00df\u03a3\u4e2d\u30a2\u30fb\u3042\u0301\u00b2\u2776\n"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_words_are_cut_as_the_patterns_say(text):
    for t in (text, text.encode("ascii", "ignore").decode()):
        assert list(zip(*pairs.tokens_in(t))) == pairs._TOKEN.findall(t) and pairs.words_in(t) == pairs._WORD.findall(t)


def test_ends_of_joining_and_cut_words():
    texts = ["The set ships with the sanding block and the hostel kitchen. It is sorry to read that. " + "Parts that break say that shops that sell them know that it is so. " * 4] * 30
    model = pairs.EndModel(texts, [])
    for text in ("The part helped a lot. Because spare parts that", "The set ships with the hostel kit", "The set ships with the sand", "先看皮带，再看木板，如果"):
        assert pairs.truncated(text, [], model), text
    for text in ("It is sorry to read that", "The set ships with the hostel kitchen", "It was cold. [edited]"):
        assert not pairs.truncated(text, [], model), text


def test_long_refusals_and_padded_stand_ins():
    assert pairs.is_empty(" " * 90 + "n/a" + "\u00a0" * 90) and not pairs.is_empty("n/a " + "word " * 30)
    text = "很抱歉，" + "关于这个问题以及与之相关的所有其他问题，" * 2 + "我无法回答。"
    for t in (text, pairs.clean("非常遗憾，这个请求我帮 不上忙。您还有其他问 题吗？"), "Je\nsuis désolé,\nmais\nje dois\nrefuser d'en parler."):
        assert pairs.RefusalAutomaton().refuses(t, t.lower())


def test_ledger_lives_on(spark, tmp_path):
    """Day 2 opens the ledger in another session, reads only its own batch, and a failed merge changes nothing."""
    rows = lambda a, b: spark.range(a, b).select(F.unhex(F.md5((F.col("id") % 7).cast("string"))).alias("key"), "id")
    first = copies.CopyLedger(spark, str(tmp_path / "ledger"), 3)
    first.merge(rows(0, 50))
    first.close()
    other = spark.newSession()
    day2 = copies.CopyLedger.open(other, str(tmp_path / "ledger"))
    assert (day2.version, day2.buckets) == (1, 3) and "Exchange" not in day2.table.groupBy("key").count()._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[1]
    with pytest.raises(Exception):
        day2.merge(other.range(1).select(F.raise_error(F.lit("lost")).cast("binary").alias("key"), "id"))
    again = copies.CopyLedger.open(other, str(tmp_path / "ledger"))
    again.merge(other.createDataFrame(rows(50, 99).toPandas()))
    got = {(bytes(r.key), r.n_copies, r.first_id) for r in again.close().collect()}
    want = {(bytes(r.key), r.n, r.f) for r in rows(0, 99).groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("f")).collect()}
    assert got == want and not [t for t in other.catalog.listTables() if t.name.startswith(again.name)]
    with pytest.raises(FileNotFoundError):
        copies.CopyLedger.open(spark, str(tmp_path / "none"))


# 3. Neighbours


def brute_lists(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in order[i] if s[i, j] > -9}


def vectors(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "vec_id BIGINT, vector ARRAY<FLOAT>")


def test_neighbours_recall_in_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    x = np.concatenate([centres[rng.integers(0, 25, 900)] + 0.3 * rng.normal(size=(900, 16)), rng.normal(size=(100, 16))]).astype(np.float32)
    got = {(r.id, r.nbr) for r in neighbours.nearest(vectors(spark, x), block=60).collect()}
    want = brute_lists(np.arange(1000), x.astype(np.float64), 5)
    assert len(got) == 5000 and len(got & want) / len(want) >= 0.95


def test_neighbours_edge_cases(spark):
    e = np.eye(4)
    x = [e[0], None, e[0] * 0, e[0], e[0] + 0.1 * e[1], [None, 1, 0, 0], [float("nan"), 1, 0, 0], e[1] * 7, e[0]]
    got = {(r.id, r.nbr) for r in neighbours.nearest(with_clashes(vectors(spark, [None if v is None else [a for a in v] for v in x[:5] + x[7:]]) if False else spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v]) for i, v in enumerate(x)], "vec_id BIGINT, vector ARRAY<FLOAT>")), k=2).collect()}
    assert got == {(0, 3), (0, 8), (3, 0), (3, 8), (8, 0), (8, 3), (4, 0), (4, 3), (7, 4), (7, 0)}
    none = spark.createDataFrame([], "vec_id BIGINT, vector ARRAY<FLOAT>")
    assert neighbours.nearest_pairs(none).count() == 0
    assert neighbours.nearest_pairs(vectors(spark, [e[0]])).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        neighbours.nearest(vectors(spark, [[1.0, 0.0], [1.0]]))


def test_many_equal_vectors(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3 + [[1.0, 1.0]]
    got = {(r.id, r.nbr) for r in neighbours.nearest(vectors(spark, x)).collect()}
    assert got == brute_lists(np.arange(34), np.array(x), 5)


def test_greedy_search_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/text_vectors.parquet")
    graph = neighbours.build_graph(v, block=20)
    data = [(r.id, np.frombuffer(r.raw, dtype=np.float32).astype(np.float64)) for r in graph.nodes.collect()]
    ids, x = np.array([i for i, _ in data]), np.stack([a / np.linalg.norm(a) for _, a in data])
    queries = graph.nodes.select(F.col("id").alias("query_id"), "raw")
    got = {(r.query_id, r.nbr) for r in neighbours.greedy_search(queries, graph).collect()}
    s = np.round(x @ x.T, 9)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in order[i]}
    assert len(got & want) / len(want) >= 0.9


def test_greedy_search_recall_of_many(spark, sf):
    """With the parameters of p3_search on a table whose graph is in separate parts."""
    graph = neighbours.build_graph(spark.read.parquet(str(Path(sf).parent / "sf0.1" / "text_vectors.parquet")))
    data = [(r.id, np.frombuffer(r.raw, dtype=np.float32).astype(np.float64)) for r in graph.nodes.collect()]
    ids, x = np.array([i for i, _ in data]), np.stack([a / np.linalg.norm(a) for _, a in data])
    queries = graph.nodes.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "raw")
    got = {(r.query_id, r.nbr) for r in neighbours.greedy_search(queries, graph).collect()}
    want = set()
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = np.round(x @ x[i], 9)
        want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, -s))[:5]}
    assert len(want) > 500 and len(got & want) / len(want) >= 0.99


def test_search_leaves_out_the_query_alone(spark, tmp_path):
    x = [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 7 + [[1.0, 1.0]] * 2
    vectors(spark, x * 9).write.parquet(str(tmp_path / "text_vectors.parquet"))
    got = {(r.query_id, r.nbr) for r in LLM.runs["p3_search"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a, b in brute_lists(np.arange(108), np.array(x * 9), 5) if a % 50 == 0}
    few = neighbours.build_graph(vectors(spark, x[2:4]))
    assert rows(neighbours.search_members(few, few.all_members())) == [(0, 1, 0.0, 1), (1, 0, 0.0, 1)]
    assert rows(neighbours.search_members(few, few.all_members().filter("id > 9"))) == []


def test_search_recall(spark, sf):
    path = str(Path(sf).parent / "sf0.1")
    data = [(r.id, r.vector) for r in spark.read.parquet(f"{path}/text_vectors.parquet").selectExpr("vec_id AS id", "vector").collect() if r.vector is not None and any(r.vector)]
    got = {(r.query_id, r.nbr) for r in LLM.runs["p3_search"](spark, path).collect()}
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = np.round(x @ x[i], 9)
        s[i] = -9
        want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, -s))[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99


def test_small_blocks_below_the_sample(spark):
    """Leaves that the sample cannot split are cut by planes; the descent joins what blocks part."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(8, 12))[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, 12))).astype(np.float64)
    tree = neighbours.fit_tree(x[:40] / np.linalg.norm(x[:40], axis=1, keepdims=True), 1500 / 40, 50, np.random.default_rng(1))
    blocks = tree.block_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert tree.bits.max() > 0 and 0 <= blocks.min() and blocks.max() < tree.blocks and len(set(blocks)) > 16
    got = {(r.id, r.nbr) for r in neighbours.nearest(vectors(spark, x.astype(np.float32)), block=100).collect()}
    want = brute_lists(np.arange(1500), x.astype(np.float32).astype(np.float64), 5)
    assert len(got) == 7500 and len(got & want) / len(want) >= 0.93


def test_parallel_vectors_go_by_id(spark):
    x = [[1.0, 2.0, 0.5]] * 1 + [[2.0**i, 2.0 ** (i + 1), 2.0 ** (i - 1)] for i in range(1, 40)]
    got = {(r.id, r.nbr) for r in neighbours.nearest(vectors(spark, x)).collect()}
    assert got == brute_lists(np.arange(40), np.array(x), 5)


# 4. Mixing


def test_water_filling_of_tiny_weights():
    assert mixing.water_fill([2.2250738585e-313, 2.225073858507203e-309], [1, 1], 2) == [1, 1]
    assert mixing.water_fill([5e-324, 1e-323, 4.0], [10, 10, 3], 9) == [2, 4, 3]
    assert mixing.water_fill([0.5, 0.25, 0.25], [10, 10, 1], 9) == mixing.water_fill([0.5e-310, 0.25e-310, 0.25e-310], [10, 10, 1], 9)


@given(st.lists(st.tuples(st.floats(0, 5), st.integers(0, 50)), min_size=1, max_size=12), st.integers(0, 300))
@settings(max_examples=300, deadline=None)
def test_water_filling(entries, size):
    weights, limits = [w for w, _ in entries], [n for _, n in entries]
    got = mixing.water_fill(weights, limits, size)
    assert all(0 <= g <= n for g, n in zip(got, limits))
    assert sum(got) == min(size, sum(n for w, n in entries if w > 0))
    free = [g / w for g, w, n in zip(got, weights, limits) if w > 0.1 and 0 < g < n]
    if free:  # one level for all that are not clamped, but for whole numbers
        assert all(abs(g - w * np.median(free)) <= 1 + 2 * w / 0.1 for g, w, n in zip(got, weights, limits) if w > 0.1 and 0 < g < n)


CONFIG = "file STRING, total_lines BIGINT, sample_ratio DOUBLE, sampled_lines BIGINT, dataset_share DOUBLE, max_repeats INT"


def test_mix(spark):
    data = [(i, None, None, None, "a") for i in range(100)] + [(100 + i, None, None, None, "b ") for i in range(10)] + [(200, None, None, None, None), (201, None, None, None, "c"), (202, None, None, None, "d")]
    df = with_clashes(spark.createDataFrame(data, RECORD))
    config = spark.createDataFrame([(" a", 10, 1.0, 1, 0.5, None), ("b", 10, 9.0, 1, 0.5, 3), ("b", 10, 9.0, 1, 0.5, 3), ("none", 5, 1.0, 5, 0.2, 1), ("c", None, None, None, None, None), (None, 1, 1.0, 1, 0.9, 1)], CONFIG)
    quotas = mixing.plan_mix(df, config)
    assert {q.source: q.n for q in quotas} == {"a": 81, "b": 30, "c": 0, "none": 0}
    mixed = mixing.mix(df, quotas)
    uses = Counter(r.rec_id for r in mixed.collect())
    assert len(uses) == 91 and all(uses[100 + i] == 3 for i in range(10)) and sum(uses.values()) == 111
    assert rows(mixed) == rows(mixing.mix(df.repartition(7), quotas))
    rep = {r.source: r for r in mixing.report(mixed, quotas).collect()}
    assert rep["b"].most_repeats == 3 and rep["b"].n_distinct == 10 and rep["none"].n_mixed == 0 and abs(rep["a"].actual_share - 81 / 111) < 1e-5
    none = spark.createDataFrame([], RECORD)
    empty = mixing.plan_mix(none, config)
    assert mixing.mix(none, empty).count() == 0 and mixing.report(mixing.mix(none, empty), empty).count() == 4
    nothing = mixing.plan_mix(df, spark.createDataFrame([], CONFIG))
    assert nothing == [] and mixing.mix(df, nothing).count() == 0


def test_water_level_of_many_sources():
    import time

    n, began = 200_000, time.time()
    got = mixing.water_fill([1.0 + i % 7 for i in range(n)], [i % 11 for i in range(n)], 500_000)
    assert sum(got) == 500_000 and all(0 <= g <= i % 11 for i, g in enumerate(got)) and time.time() - began < 20


# 5. Packing


@given(st.dictionaries(st.integers(0, 64), st.integers(1, 30), max_size=30), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_plan_of_a_source(histogram, groups):
    fill, places = defaultdict(int), Counter()
    for length, a, b, c, phase, each in packing.plan_source(histogram, 64, groups, 8):
        for r in range(a, b):
            places[length, r] += 1
            fill[c + (r - a + phase) // each] += length
    assert places == Counter({(x, r): 1 for x, n in histogram.items() for r in range(n)})
    assert all(v <= 64 for v in fill.values())
    if sum(n for x, n in histogram.items() if x > 8) <= groups:  # every large item is its own group: nothing is rounded up
        total = sum(x * n for x, n in histogram.items())
        assert len(fill) <= 2 * -(-total // 64) + 1


def test_pack(spark):
    lengths = [0, 0, 1, 2048, 2049, 5000, 700, 700, 648, 1, 2047] + [300] * 50
    df = spark.createDataFrame([(i, None, ["x" * n] if n else None, None, None if i % 2 else "s") for i, n in enumerate(lengths)], RECORD)
    got = packing.pack(packing.items_of(with_clashes(df))).collect()
    fill, parts = Counter(), defaultdict(list)
    for r in got:
        fill[r.source, r.container] += r.length
        parts[r.id].append((r.piece_no, r.start, r.length))
    assert max(fill.values()) <= 2048 and sorted(parts) == list(range(len(lengths)))
    for i, p in parts.items():
        p.sort()
        assert sum(x for _, _, x in p) == lengths[i] and [s for _, s, _ in p] == [2048 * k for k in range(len(p))]
        assert len(p) == max(1, -(-lengths[i] // 2048))
    assert packing.report(packing.pack(packing.items_of(df))).count() == 2
    assert packing.pack(packing.items_of(spark.createDataFrame([], RECORD))).count() == 0


def test_pack_is_tight(spark, sf):
    rep = packing.report(packing.pack(packing.items_of(spark.read.parquet(f"{sf}/normalised.parquet")))).collect()
    for r in rep:
        assert r.most_used <= 2048 and r.containers <= 1.1 * (r.chars / 2048) + 1


# 6. Encoding

TEXTS = [None, "", " ", "a", "<|endoftext|> x", "Hello  world\r\n\n  it's 12,5 €!", "汉字和假名カナ🦆", "a" * 5000, "ab" * 3000, " " * 300 + "x", "\u0000​﻿", "".join(chr(0x4E00 + i % 900) for i in range(900)), "def f(x):\n\treturn x", "é" * 50]


def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_of_edge_cases(spark):
    df = with_clashes(spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4])], "doc_id BIGINT, text STRING"))
    got = bpe.encode_corpus(df).collect()
    ref = reference()
    assert len(got) == len(TEXTS) + 1 and all(list(r.ids) == ref(TEXTS[r.doc_id] or "") for r in got)
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_ids_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ref = reference()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in LLM.runs["p6_ids"](spark, sf).collect()}
    assert got == {d: ref(t) for d, t in text.items()}


@given(st.lists(st.text(alphabet="abe ing the汉é-=", min_size=1, max_size=40), min_size=1, max_size=10))
@settings(max_examples=15, deadline=None)
def test_words_as_the_library(words):
    import regex

    b = bpe.DuckBpe(*bpe.read_merges(bpe.default_tokenizer()))
    ref = reference()
    for w in words:
        cut = regex.findall(bpe.PATTERN, w)
        assert [i for x in b.encode(cut) for i in x] == ref(w)


# 7. Leaks


def brute_leaks(docs, items):
    found = set()
    for i, lang, text in items:
        cut, least = (leaks.chars_of, 24) if (lang or "").lower() == "zh" else (leaks.words_of, 12)
        u = list(cut(text or ""))
        grams = {tuple(u[k : k + least]) for k in range(len(u) - least + 1)}
        for d, t in docs:
            v = list(cut(t or ""))
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                found.add((d, i))
    return found


def test_leaks_edge_cases(spark):
    w = [f"w{i}" for i in range(30)]
    zh = "".join(chr(0x4E00 + i) for i in range(40))
    items = [(1, "en", " ".join(w[:15])), (2, "EN", " ".join(w[3:18])), (3, "zh", zh[:30]), (4, None, None), (5, "en", ""), (6, "en", "a b c"), (7, "ZH", "x" * 30), (1, "en", " ".join(w[:15]))]
    docs = [
        (1, "foo " + " ".join(w[:12]).upper() + " bar"), (2, "foo " + " ".join(w[:11])), (3, "-".join(w[2:20])), (4, None), (5, ""), (6, "（" + "，".join(zh[:24]) + "）"), (7, zh[:23]), (8, "foo " + " ".join(w[:12])),
        (9, "z " * 50_000 + " ".join(w)), (10, "x" * 24), (11, " ".join(["w0"] * 40)), (8, "foo " + " ".join(w[:12])),
    ]
    d = with_clashes(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"))
    i = with_clashes(spark.createDataFrame(items, "item_id BIGINT, lang STRING, text STRING"))
    for size in (1 << 20, 40):
        got = leaks.find_matches(d.coalesce(1), i, shard_units=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
        assert next(r.matched for r in got if (r.doc_id, r.item_id) == (3, 1)) == 13
    whole = rows(leaks.find_matches(d, i.dropDuplicates(["item_id"])).select("doc_id", "item_id", "matched"))
    assert rows(leaks.find_matches(d, i.dropDuplicates(["item_id"]), item_chars=60).select("doc_id", "item_id", "matched")) == whole  # in several blocks of items
    assert {r.doc_id for r in leaks.remove_leaked(d, leaks.find_matches(d, i)).collect()} == {2, 4, 5, 7, 11}
    assert leaks.find_matches(d.limit(0), i).count() == 0 and leaks.find_matches(d, i.limit(0)).count() == 0


def test_repetitive_leaks(spark):
    """A passage that repeats itself in item and document, in many documents, and its longest match."""
    item = " ".join(["a b"] * 60)
    docs = [(k, f"x{k} " + " ".join(["a b"] * 40) + " y") for k in range(30)]
    got = leaks.find_matches(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame([(1, "en", item)], "item_id BIGINT, lang STRING, text STRING")).collect()
    assert len(got) == 30 and all((r.matched, r.doc_pos, r.item_pos) == (80, 1, 0) for r in got)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(units):
    order = leaks.suffix_array(np.array(units, dtype=np.int64), 4)
    assert sorted(order.tolist()) == list(range(len(units)))
    keys = [tuple(units[i : i + 4]) for i in order]
    assert keys == sorted(keys)


# 8. Splitting


@pytest.fixture(scope="module")
def cutter():
    import tiktoken

    ranks = splitting.read_ranks(splitting.default_tokenizer())
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for b, i in ranks.items():
        sizes[i] = len(b)
    return tiktoken.Encoding("own", pat_str=splitting.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def sound(text, encode, sizes):
    ids = encode(text)
    pieces = splitting.split_text(text, ids, sizes)
    raw = text.encode()
    bounds = np.concatenate(([0], np.cumsum(sizes[ids])))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
    for a, b, piece in pieces:
        assert 0 < b - a <= 512 and piece.encode() == raw[bounds[a] : bounds[b]]
    for (_, b, _), (a, _, _) in zip(pieces, pieces[1:]):
        assert 64 <= b - a <= 67
    return pieces


def test_pieces(cutter):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    prose = "\n\n".join(" ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(12)) for _ in range(12))
    for text in (prose, "x" * 4000 + prose, "🦆" * 2000, "汉" * 3000, "a" * 9000, " \n" * 3000, "".join(rng.choices("abcdefghijklmnop0123456789", k=6000)), prose.replace(" ", " ")):
        sound(text, *cutter)
    ends = [p[2].rstrip()[-1] for p in sound(prose, *cutter)]
    assert set(ends) == {"."}


def test_topic_change_is_found(cutter):
    pets = " ".join(f"The kitten chased another puppy around garden number {i}." for i in range(30))
    cars = " ".join(f"Heavy engines burned diesel along motorway section {i}." for i in range(40))
    first = sound(pets + " " + cars, *cutter)[0][2]
    assert "kitten" in first and "diesel" not in first


def test_split_documents(spark):
    long = "One two three. " * 400
    df = with_clashes(spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, long), (4, long)], "doc_id BIGINT, text STRING"))
    got = splitting.split_documents(df).collect()
    assert {r.doc_id for r in got} == {4} and all(r.n_tokens == r.token_end - r.token_start <= 512 for r in got)
    assert splitting.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(df, overlap=400)
