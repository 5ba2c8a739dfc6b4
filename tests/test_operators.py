import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import hashing, text, vectors
from quillstone.operators import changes, chunking, evaluation, fulltext, graph, parsing, retrieval, running, temporal
from quillstone.plans import retrieval as retrieval_plans
from tests.conftest import rows


def runs(spark, lists):
    return spark.createDataFrame([("q", i, r + 1) for i, r in lists], "evaluation_id string, item string, rank int")


def metrics(spark, ranked, gold, k):
    got = spark.createDataFrame([("s", "q", x, n + 1) for n, x in enumerate(ranked)], "arm string, evaluation_id string, item string, rank int")
    expected = evaluation.gold_items(spark.createDataFrame([("q", gold)], "evaluation_id string, ids array<string>"), "evaluation_id", "ids")
    found = evaluation.hits(got, expected, ["arm"], "evaluation_id", "item")
    return evaluation.metrics_at(found, ["arm"], "evaluation_id", [k]).first()


@pytest.mark.parametrize("ranked, k, recall", [("ayz", 3, 1 / 3), ("abx", 3, 2 / 3), ("abc", 2, 2 / 3)])
def test_recall(spark, ranked, k, recall):
    assert metrics(spark, list(ranked), ["a", "b", "c"], k).recall == pytest.approx(recall)


@pytest.mark.parametrize("ranked, mrr", [("xa", 0.5), ("xya", 0.0)])
def test_mrr(spark, ranked, mrr):
    assert metrics(spark, list(ranked), ["a", "b"], 2).mrr == mrr


def test_ndcg(spark):
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert metrics(spark, ["x", "a", "y"], ["a", "b", "c"], 3).ndcg == pytest.approx(1 / math.log2(3) / ideal)


def test_repeated_and_null_gold(spark):
    gold = evaluation.gold_items(spark.createDataFrame([("q", ["a", None, "a"])], "evaluation_id string, ids array<string>"), "evaluation_id", "ids")
    assert rows(gold) == [("q", "a", 1)]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)] + [(None,)], "v double")
    assert tuple(evaluation.percentiles(df, [], "v", [0.25, 0.5, 0.75]).first()) == (5, 2.0, 3.0, 4.0)


def test_fusion_tie_goes_to_smaller_item(spark):
    a = spark.createDataFrame([("q", "b", 1)], "q string, item string, rank int")
    b = spark.createDataFrame([("q", "a", 1)], "q string, item string, rank int")
    assert [r.item for r in retrieval.reciprocal_rank_fusion(a, b, ["q"], "item").orderBy("rank").collect()] == ["a", "b"]


def test_ordered_union(spark):
    a = spark.createDataFrame([("q", "v2", 1), ("q", "v1", 2)], "q string, item string, rank int")
    b = spark.createDataFrame([("q", "v1", 1), ("q", "w", 2)], "q string, item string, rank int")
    got = retrieval.ordered_union([a, b], ["q"], "item").orderBy("position").collect()
    assert [r.item for r in got] == ["v2", "v1", "w"]


def test_visible_is_not_a_fan_out(spark):
    chunks = spark.createDataFrame([(1, "s", "shared"), (2, "t", "SCOPED"), (3, "u", "SCOPED"), (4, None, "SCOPED")], "id int, source_id string, visibility string")
    access = spark.createDataFrame([("t", "credit"), ("t", "credit"), ("u", "risk")], "source_id string, scope string")
    assert [r.id for r in retrieval.visible(chunks, access, F.lit("credit")).orderBy("id").collect()] == [1, 2]


def test_empty_lists_agree_and_threshold_comes_after_the_limit(spark):
    df = spark.createDataFrame([("q", str(i), 1 - i / 10) for i in range(9)], "q string, item string, s double")
    got = retrieval.over_fetch(df, ["q"], "s", "item", 1, 0.95, factor=2).collect()
    assert [r.item for r in got] == ["0"]


def test_text(spark):
    df = spark.createDataFrame([("﻿A  b\r\nC", "Điều kiện", "[E1] x [E02] [E1]")], "a string, b string, c string")
    r = df.select(text.compact(text.unified_newlines(F.col("a"))), text.slug(F.col("b")), text.citations(F.col("c")), text.upper_share(F.col("b")),
                  text.safe_name(F.lit("../a b/c?.txt"))).first()
    assert tuple(r) == ("A b C", "dieu-kien", [1, 2], 1 / 8, "a_b_c_.txt")


def test_copied_stretches(spark):
    from quillstone.plans.common import copied_stretch

    passage = "".join(f"word{i} " for i in range(60))
    cases = [("is it " + passage[150:230] + "?", passage, True), ("is it " + passage[150:229] + "?", passage, False), ("say short text now", "short text", True),
             ("nothing", passage, False), ("x" * 80, "", True), ("x", None, None), (None, "y", None)]
    df = spark.createDataFrame([(i, q, p) for i, (q, p, _) in enumerate(cases)], "i int, q string, p string")
    assert [r.c for r in df.select("i", copied_stretch(F.col("q"), F.col("p")).alias("c")).orderBy("i").collect()] == [c for *_, c in cases]


def test_excerpt_ends_at_a_word(spark):
    r = spark.range(1).select(text.excerpt(F.lit("one two three four"), 10).alias("e")).first()
    assert r.e == "one two…"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(0.96), None, None]
    got = df.select(vectors.defect(F.col("a"), 2).alias("d")).collect()
    assert [r.d for r in got] == ["not unit", "zero", "missing"]


def test_search_in_blocks_is_search(spark):
    df = spark.createDataFrame([(i, [float(i % 3 + 1), float(i)]) for i in range(40)] + [(99, None), (98, [1.0])], "id long, vector array<float>")
    queries = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    whole, parts = (rows(vectors.search(queries, df, 3, 2, block=b).select("query_id", "id", "rank")) for b in (100, 2))
    assert whole == parts and len(whole) == 12


def test_identity_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    ids = [r.i for r in df.select(hashing.identity("x", "y").alias("i")).collect()]
    assert ids[0] == ids[2] != ids[1]


def test_lossless_split():
    t = ("Một câu ngắn. " * 400) + "\n\n" + "x" * 6000 + " end"
    spans = chunking.lossless(t)
    assert "".join(t[a:b] for a, b in spans) == t and max(b - a for a, b in spans) <= 2400
    assert chunking.lossless("") == [] and chunking.lossless("ab") == [(0, 2)]


def test_overlapping_split():
    t = "word " * 200
    spans = chunking.overlapping(t, 200, 30)
    assert max(b - a for a, b in spans) <= 200 and all(b[0] < a[1] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(t)
    assert chunking.overlapping("  \n ", 200, 30) == [] and chunking.overlapping("", 200, 30) == []
    t = "A first sentence here. A second one follows.\nA line, and more text behind it that goes on and on without end"
    spans = chunking.overlapping(t, 50, 10)
    assert t[: spans[0][1]] == "A first sentence here. A second one follows.\n" and spans[1][0] == spans[0][1] - 10


def test_sections_and_headings(spark):
    df = spark.createDataFrame([(1, "intro\r\nĐiều 1. A\n\nbody\nChương 2: B"), (2, None)], "id long, t string")
    lined = parsing.lines(df, "id", "t")
    assert [(r.line, r.level, r.number) for r in parsing.headed(lined).orderBy("line").collect()] == [(1, None, None), (2, "điều", 1), (4, "điều", 1), (5, "chương", 2)]
    assert [r.lines for r in parsing.sections(lined).orderBy("section").collect()] == [1, 2, 1]


def test_levels_end_where_one_above_begins(spark):
    t = "PHẦN 1\nChương 2\nMục 3\nĐiều 4. A\n1. one\na) x\nbody\nĐiều 5. B\nbody\nChương 3\nbody\n第7章 c\n第8条 d\n2) two"
    got = parsing.levelled(parsing.lines(spark.createDataFrame([(1, t), (2, None)], "id long, t string"), "id", "t")).orderBy("line")
    assert [tuple(r[n] for n in parsing.LEVELS) for r in got.collect()] == [
        ("1", None, None, None, None, None), ("1", "2", None, None, None, None), ("1", "2", "3", None, None, None), ("1", "2", "3", "4", None, None), ("1", "2", "3", "4", "1", None),
        ("1", "2", "3", "4", "1", "a"), ("1", "2", "3", "4", "1", "a"), ("1", "2", "3", "5", None, None), ("1", "2", "3", "5", None, None), ("1", "3", None, None, None, None),
        ("1", "3", None, None, None, None), ("1", "7", None, None, None, None), ("1", "7", None, "8", None, None), ("1", "7", None, "8", "2", None)]


def test_cleaned(spark):
    df = spark.createDataFrame([("ﬁle\u200b \u00adx  \r\nđiê ̀u\ufeff №５",), (None,), ("",)], "t string")
    assert [r.c for r in df.select(text.cleaned(F.col("t")).alias("c")).collect()] == ["file x\nđiều No5", None, ""]


def test_running_budget_over_blocks(spark):
    df = spark.createDataFrame([("s", i // 3, i, 10) for i in range(10)], "k string, day int, id int, n int")
    got = running.within_budget(df, ["k"], F.col("day"), ["id"], "n", 45).orderBy("id").collect()
    assert [(r.id, r.taken) for r in got] == [(0, 10), (1, 10), (2, 10), (3, 10), (4, 5)]


def test_islands_across_blocks(spark):
    data = [("g", 1, 1, "a"), ("g", 1, 2, "a"), ("g", 2, 3, "a"), ("g", 2, 4, None), ("g", 3, 5, None), ("g", 3, 6, "b"), ("g", 7, 7, "a"), (None, 1, 8, "b"), (None, 2, 9, "b"), ("h", 1, 10, None)]
    df = spark.createDataFrame(data, "k string, page int, id int, x string")
    got = running.islands_in_blocks(df, ["k"], F.col("page"), "id", ["x"])
    assert [(r.id, r.island) for r in got.orderBy("id").collect()] == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 4), (8, 1), (9, 1), (10, 1)]


def test_percentiles_of_one_large_group(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = np.round(np.r_[rng.exponential(3, 4000), [0.0] * 500, 1e6], 3)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 2.0), ("h", 4.0), (None, 1.0), ("g", None)], "k string, v double")
    got = {r.k: r for r in evaluation.percentiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert [got["g"][f"p{p}"] for p in (0, 50, 95, 100)] == [pytest.approx(round(float(np.percentile(values, p)), 6)) for p in (0, 50, 95, 100)]
    assert (got["h"].p50, got["h"].n, got[None].p95) == (3.0, 2, 1.0)


def test_changes(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "w", 1)], "k int, s string, n int")
    assert rows(changes.changed_columns(a, b, ["k"], ["s", "n"])) == [(1, "SAME", []), (2, "CHANGED", ["n"]), (3, "GONE", []), (4, "NEW", [])]
    assert rows(changes.upsert_plan(a, b, ["k"], ["s", "n"]).select("k", "state")) == [(1, "SAME"), (2, "CONFLICT"), (4, "NEW")]
    assert changes.difference(a, a).count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("d", "c")], "node string, parent string")
    assert rows(graph.layers(edges)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert graph.on_cycles(edges).count() == 0
    loop = edges.unionByName(spark.createDataFrame([("x", "y"), ("y", "x")], "node string, parent string"))
    assert rows(graph.on_cycles(loop)) == [("x",), ("y",)]
    with pytest.raises(ValueError):
        graph.ancestors(loop)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = dict(rows(graph.components(spark.createDataFrame(chain, "a long, b long"))))
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_as_of(spark):
    left = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("v", 9, "c")], "k string, t int, name string")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50)], "k string, t int, x int")
    assert rows(temporal.as_of(left, right, ["k"], "t", ["x"]).select("name", "x")) == [("a", None), ("b", 50), ("c", None)]


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "a b"), (3, "a a a")], "id long, t string")
    terms = fulltext.query_terms(spark.createDataFrame([("q", "a b")], "q string, t string"), "q", "t")
    got = fulltext.cover_density(fulltext.postings(docs, "id", {"t": "C"}), terms, 5).orderBy("rank").collect()
    assert [(r.id, r.covers) for r in got] == [(2, 1), (1, 1)]


def test_unfinished_rounds_are_errors(spark):
    links = [(i, i + 1) for i in range(12)]
    chain = spark.createDataFrame(links, "a long, b long")
    with pytest.raises(ValueError):
        graph.components(chain, most=1)


def test_long_chains_and_deep_graphs(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "node long, parent long")
    assert graph.on_cycles(chain).count() == 0
    loops = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(0, 1), (39, 40), (100, 0), (40, 200), (300, 301)], "node long, parent long")
    assert rows(graph.on_cycles(loops)) == sorted(((i,) for i in range(41)), key=repr)
    deep = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(100, 0), (100, 50)], "node long, parent long")
    assert graph.ancestors(deep).where("node = 100 AND ancestor = 0").first().depth == 100
    assert graph.components(chain.toDF("a", "b")).select("component").distinct().count() == 1


def test_checkpoints_need_a_shared_folder():
    from quillstone import session

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake)
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[3,2,1024]")


def brute_covers(docs, terms):
    """(id, covers, score) of every match, by the definition."""
    every = {}
    for i, words in docs.items():
        at = [(p, w) for p, w in enumerate(words) if w in terms]
        spans = [(a, b) for a, _ in at for b, _ in at if terms <= set(words[a:b + 1])]
        least = [(a, b) for a, b in spans if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in spans)]
        if least:
            every[i] = (len(least), round(sum(len(terms) / (1 + b - a + 1 - len(terms)) for a, b in least), 6))
    some = {i: (n, float(n)) for i, words in docs.items() if (n := sum(w in terms for w in words))}
    return sorted(((i, *c) for i, c in (every or some).items()), key=lambda r: (-r[2], r[0]))


def test_covers_hold_all_terms_of_a_query(spark):
    draw = random.Random(7)
    docs = {i: draw.choices("abcdefgh", k=draw.randrange(40)) for i in range(60)}
    asked = {"three": "a b c", "six": "f e d c b a", "one": "h", "none": "a b zzz", "nothing": "zzz"}
    df = spark.createDataFrame([(i, " ".join(w[:5]), " ".join(w[5:])) for i, w in docs.items()], "id long, h string, t string")
    terms = fulltext.query_terms(spark.createDataFrame(list(asked.items()), "q string, t string"), "q", "t")
    want = sorted((q, *r, n) for q, t in asked.items() for n, r in enumerate(brute_covers(docs, set(t.split()))[:12], 1))
    columns = ["query_id", "id", "covers", "score", "rank"]
    fields = {"h": "B", "t": "C"}
    for got in (fulltext.cover_search(df, "id", fields, terms, 12), fulltext.cover_search(df, "id", fields, terms, 12, block=2), fulltext.cover_density(fulltext.postings(df, "id", fields), terms, 12)):
        assert sorted(tuple(r) for r in got.select(columns).collect()) == want


def test_cover_density_query_uses_every_term(spark):
    sf = "/root/testdata/sf0.001"
    chunks = {r.chunk_id: r.w for r in retrieval_plans._titled(spark, sf).select("chunk_id", text.tokens(F.concat_ws(" ", *retrieval_plans._TITLED)).alias("w")).collect()}
    asked = {}
    for r in retrieval_plans._terms(spark, sf).collect():
        asked.setdefault(r.query_id, set()).add(r.term)
    want = sorted((q, *r, n) for q, t in asked.items() for n, r in enumerate(brute_covers(chunks, t)[:10], 1))
    got = retrieval_plans.fulltext_cover_density(spark, sf).select("query_id", "id", "covers", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == want and max(map(len, asked.values())) > 2


def test_titles_are_indexed(spark):
    sf = "/root/testdata/sf0.001"
    assert "title" in retrieval_plans._TITLED
    title = spark.read.parquet(f"{sf}/policy_documents.parquet").select(F.explode(text.tokens(F.col("title"))).alias("term")).distinct()
    counts = retrieval_plans.titled_term_statistics(spark, sf).where("in_titles > 0")
    assert counts.count() > 0 and counts.join(title, "term", "left_anti").count() == 0
    plain = {(r.query_id, r.id): r.score for r in retrieval_plans.fulltext_any(spark, sf).collect()}
    assert any(r.score > plain.get((r.query_id, r.id), math.inf) for r in retrieval_plans.fulltext_titled_any(spark, sf).collect())


def test_fulltext_modes(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "id long, t string")
    terms = fulltext.query_terms(spark.createDataFrame([("q", "Alpha BETA alpha"), ("e", "?"), ("r", "beta")], "q string, t string"), "q", "t")
    every = fulltext.search(docs, "id", {"t": "A"}, terms, "and", 5)
    assert rows(every.select("query_id", "id", "matched", "score")) == [("q", 1, 2, 2.0), ("r", 1, 1, 1.0)]
    some = fulltext.search(docs, "id", {"t": "A"}, terms, "or", 5)
    assert rows(some.select("query_id", "id", "rank")) == [("q", 1, 1), ("q", 2, 2), ("r", 1, 1)]
    assert rows(fulltext.search(docs, "id", {"t": "A"}, terms, "or", 5, block=1)) == rows(some)
