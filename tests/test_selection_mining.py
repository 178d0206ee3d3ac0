import random

import pytest
from pyspark.sql import functions as F

from latentlake.operators import encode, mining, ranking, selection

STATS = "latent_idx bigint, z_max double, variance double, sparsity double"


def greedy(scores, parents, n, max_children, preferred, target):
    """Plain restatement of the rule: seeds first, then the best next child, one at a time."""
    import statistics

    kids = {}
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        kids.setdefault(parents[i], []).append(i)
    ranked = sorted(kids, key=lambda p: (-scores[kids[p][0]], p))
    preferred = min(preferred, max_children)
    target = target or -(-n // preferred)
    penalty = statistics.median(scores[kids[p][0]] for p in ranked[:target]) / max(2, 2 * preferred)
    quota = dict.fromkeys(ranked, 0)
    for group in (ranked[:target], ranked[target:]):
        for p in group:
            if sum(quota.values()) < n:
                quota[p] = max(quota[p], 1)
        while sum(quota.values()) < n:
            options = [
                ((scores[kids[p][quota[p]]] - penalty * quota[p], scores[kids[p][quota[p]]], -quota[p], -p), p)
                for p in group
                if quota[p] < min(max_children, len(kids[p]))
            ]
            if not options:
                break
            quota[max(options)[1]] += 1
    return [i for p in ranked for i in kids[p][: quota[p]]][:n]


@pytest.mark.parametrize("seed", range(6))
def test_parent_balanced_equals_greedy_loop(spark, seed):
    rng = random.Random(seed)
    size, groups = 40, rng.randint(2, 9)
    low = -2.0 if seed % 2 else 0.0  # negative scores make the penalty negative
    scores = [round(rng.uniform(low, 1.0 if low else 3.0), 1) for _ in range(size)]
    parents = [rng.randrange(groups) for _ in range(size)]
    stats = spark.createDataFrame([(i, s, 0.0, 0.0) for i, s in enumerate(scores)], STATS)
    table = spark.createDataFrame(list(enumerate(parents)), "latent_idx bigint, parent bigint")
    n, cap, pref = rng.randint(3, 30), rng.randint(1, 6), rng.randint(1, 5)
    target = rng.choice([None, 2, 3])
    out = selection.parent_balanced(stats, table, n, cap, pref, target).orderBy("sel_pos").collect()
    assert [r["latent_idx"] for r in out] == greedy(scores, parents, n, cap, pref, target)


def test_select_rejects_bad_input(spark):
    stats = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], STATS)
    with pytest.raises(ValueError):
        selection.select_latents(stats, "top_activation", 0)
    with pytest.raises(ValueError):
        selection.select_latents(stats, "manual", 1)
    with pytest.raises(ValueError):
        selection.select_latents(stats, "sdf_parent_balanced", 1)


def test_unseen_topk_latents_rank_last(spark):
    stats = spark.createDataFrame([(0, None, 0.0, 0.0), (1, -3.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0)], STATS)
    out = selection.select_latents(stats, "top_activation", 3).orderBy("sel_pos").collect()
    assert [r["latent_idx"] for r in out] == [2, 1, 0]


TOP = "latent_idx bigint, source_rank int, slide_key string, tile_index bigint, coord_x int, coord_y int, z double"


def greedy_spread(rows, topn, cap, px):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        near = [k for k in kept if k[2] == r[2]]
        if cap > 0 and len(near) >= cap:
            continue
        if px > 0 and any((k[4] - r[4]) ** 2 + (k[5] - r[5]) ** 2 < px * px for k in near):
            continue
        kept.append(r)
        if topn and len(kept) >= topn:
            break
    return [r[3] for r in kept]


@pytest.mark.parametrize("cap,px,topn", [(2, 300, 10), (0, 300, 0), (3, 0, 8), (0, 0, 5), (1, 700, 0)])
def test_diversify_equals_greedy_loop(spark, cap, px, topn):
    rng = random.Random(cap * 100 + px)
    rows = [(0, i + 1, f"S{rng.randrange(4)}", i, rng.randrange(8) * 128, rng.randrange(8) * 128, 1.0 - i / 100) for i in range(60)]
    top = spark.createDataFrame(rows, TOP)
    out = mining.diversify(top, topn, cap, px).orderBy("source_rank").collect()
    assert [r["tile_index"] for r in out] == greedy_spread(rows, topn, cap, px)
    assert [r["source_rank"] for r in out] == list(range(1, len(out) + 1))


def test_overfetch():
    assert mining.overfetch(50, 4.0) == 200
    assert mining.overfetch(50, 1.0) == 50
    assert mining.overfetch(3, 1.1) == 4


def test_top_tiles_of_a_hot_latent_are_limited_below_the_shuffle(spark):
    acts = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 7, id % 50) as latent_idx", "concat('S', id % 40) as slide_key", "id as tile_index",
        "0 as coord_x", "0 as coord_y", "double(hash(id) % 1000 + 1001) as z",
    )
    top = mining.top_tiles(acts, None, 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    per = {r["latent_idx"]: r["count"] for r in top.groupBy("latent_idx").count().collect()}
    assert set(per.values()) == {5}


def support(spark):
    rows = [(9.0, 1, "A", 1), (8.0, 2, "B", 2), (7.0, 3, "B", 3), (6.0, 4, "B", 4), (5.0, 5, "A", 5)]
    df = spark.createDataFrame(rows, "activation double, source_rank int, slide_key string, tile_index bigint")
    df = df.select("*", F.lit("s").alias("latent_strategy"), F.lit(3).alias("latent_idx"))
    return ranking.slide_support_stats(df)


@pytest.mark.parametrize(
    "method,tiles",
    [
        ("max_activation", [1, 2, 3, 4, 5]),
        ("median_activation", [3, 2, 4, 1, 5]),
        ("diverse_support", [1, 2, 3, 4, 5]),
        ("slide_spread", [2, 3, 4, 1, 5]),
    ],
)
def test_rank_orders(spark, method, tiles):
    ranked = ranking.rank_support(support(spark), (method,)).orderBy("method_rank").collect()
    assert [r["tile_index"] for r in ranked] == tiles
    assert ranking.representatives(ranking.rank_support(support(spark), (method,))).first()["tile_index"] == tiles[0]


def test_unknown_ranking_is_an_error(spark):
    with pytest.raises(ValueError):
        ranking.rank_support(support(spark), ("best",))


def test_margin_counts_absent_latents_as_zero(spark):
    hits = spark.createDataFrame(
        [("S", 0, 1, 3.0), ("S", 0, 2, 1.0), ("S", 1, 1, 2.0), ("S", 2, 1, -1.0)],
        "slide_key string, tile_index bigint, latent_idx bigint, z double",
    )
    out = {(r["tile_index"], r["latent_idx"]): r["margin"] for r in encode.margin(hits, 4).collect()}
    assert out == {(0, 1): 2.0, (0, 2): -2.0, (1, 1): 2.0, (2, 1): -1.0}
