import heapq
import random

import numpy as np

from paperloom.llm.mixing import fill_level, mix_sources, numbered_sources, sainte_lague, seat_counts


def brute_seats(votes, seats, caps):
    out = [0] * len(votes)
    heap = [(-float(v), i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        seats -= 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def brute_targets(sizes, weights):
    """Raise all targets together until each is full or the total is reached."""
    left, fixed = 1.5 * sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        unit = (left - sum(fixed.values())) / sum(weights[i] for i in rest) if rest else 0
        over = [i for i in rest if weights[i] * unit > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * unit) for i in range(len(sizes))]
        fixed |= {i: 2.0 * sizes[i] for i in over}


def test_apportionment():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 9)
        votes = np.array([rng.choice([0, 1, 7, 7, 50, 1000]) + rng.random() * rng.choice([0, 1]) for _ in range(n)])
        caps = np.array([rng.randrange(0, 60) for _ in range(n)])
        seats = rng.randrange(0, 120)
        assert sainte_lague(votes, seats, caps).tolist() == brute_seats(votes, seats, caps)


def test_searches_over_the_table_of_sources(spark):
    rng = random.Random(11)
    for n in (1, 2, 3, 7, 40):
        sizes = [rng.choice([0, rng.randrange(1, 500), 90_000]) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        level = fill_level(spark.createDataFrame([(2 * s, float(w)) for s, w in zip(sizes, weights)], "cap long, weight double"), 1.5 * sum(sizes))
        assert np.allclose([min(2 * s, w * level) for s, w in zip(sizes, weights)], brute_targets(sizes, weights))
        votes, caps = [float(rng.choice([0, 7, 7, rng.random() * 1000])) for _ in range(n)], [rng.randrange(0, 60) for _ in range(n)]
        for seats in (0, 3 * n, 10_000):
            got = seat_counts(spark.createDataFrame(list(zip(range(n), votes, caps)), "number long, votes double, cap long"), seats)
            assert [r["quota"] for r in got.orderBy("number").collect()] == brute_seats(votes, seats, caps), (votes, caps, seats)


def test_sources_are_numbered_in_code_point_order(spark):
    names = ["b", "", None, "é", "Z", "日", "a", "a"]
    rows = spark.createDataFrame([(x, 1) for x in names], "source string, size long").repartition(3)
    got = {r["name"]: (r["number"], r["source_size"]) for r in numbered_sources(rows).collect()}
    assert got == {x: (i, names.count(x)) for i, x in enumerate(["", "Z", "a", "b", "é", "日", None])}


def brute_taken(spark, docs, shard_words, block=64, seed=17):
    """Takings of each document by loops; only the hashes come from Spark."""
    ids = spark.createDataFrame([(i,) for i, *_ in docs], "id long").selectExpr("id", f"xxhash64({seed}, cast(id as string)) as draw").selectExpr("id", "draw", "xxhash64(draw, 1) as u").distinct().collect()
    draw = {r["id"]: (r["draw"], r["u"]) for r in ids}
    names = sorted({s for *_, s in docs}, key=lambda x: (x is None, x or ""))
    size = {i: len((t or "").split()) for i, t, _ in docs}
    totals = [sum(size[i] for i, _, s in docs if s == x) for x in names]
    target = brute_targets(totals, [(3, 1, 2)[k % 3] for k in range(len(names))])
    shards = {}
    for i, _, s in docs:
        k = names.index(s)
        shards.setdefault((k, draw[i][1] % max(1, -(-totals[k] // shard_words))), []).append(i)
    blocks = {key: -(-sum(size[i] for i in x) // block) for key, x in shards.items()}
    quota = brute_seats(target, round(sum(target) / block), [2 * sum(n for (k, _), n in blocks.items() if k == j) for j in range(len(names))])
    taken = {}
    for j in range(len(names)):
        mine = sorted(key for key in shards if key[0] == j)
        given = brute_seats([sum(size[i] for i in shards[key]) for key in mine], quota[j], [2 * blocks[key] for key in mine])
        for key, q in zip(mine, given):
            n = blocks[key]
            hashes = {r["b"]: r["h"] for r in spark.range(n).selectExpr("id as b", f"xxhash64({seed}, {key[0]}L, {key[1]}, id) as h").collect()}
            more = set(sorted(hashes, key=hashes.get)[: q % n if n else 0])
            at = 0
            for i in sorted(shards[key], key=lambda i: (draw[i][0], i)):
                words = range(at, at + size[i])
                taken[i] = sum(q // n + (w // block in more) for w in words)
                at += size[i]
    return taken


def test_takings_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, "w " * rng.choice([0, 1, 30, 500]), rng.choice(["a", "b", "b", None])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mix_sources(df, shard_words=3_000).collect()}
    assert got == brute_taken(spark, docs, 3_000)


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, "w " * rng.choice([0, 1, 30, 700]), rng.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix_sources(df, shard_words=20_000)
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(df.repartition(7), shard_words=20_000).collect()))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and len(rows) == len(docs)
    source = {i: s for i, _, s in docs}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(t.split()) for i, t, _ in docs}
    for name in {"a", "b", "c", None, "é"}:
        mine = [r for r in rows if source[r["doc_id"]] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 64 * 4
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)


def test_odd_rows(odd, none):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mix_sources(none).count() == 0


def test_the_searches_take_few_jobs(spark):
    rng = random.Random(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    sources = spark.createDataFrame([(2 * rng.randrange(1, 10**7), float((3, 1, 2)[i % 3])) for i in range(50)], "cap long, weight double")
    before = jobs()
    fill_level(sources, 1e8)
    assert jobs() - before <= 8
    parties = spark.createDataFrame([(i, rng.random() * 1e6, 10**6) for i in range(50)], "number long, votes double, cap long")
    before = jobs()
    seat_counts(parties, 400_000).count()
    assert jobs() - before <= 14


def test_many_sources_meet_in_salts(spark, monkeypatch):
    from paperloom.llm import mixing

    docs = [(i, "w " * (i % 70), f"s{i % 3}" if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = sorted(map(tuple, mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, mix_sources(df).collect())) == want


def test_rows_without_identifiers_share_the_shards(spark):
    df = spark.createDataFrame([(None, f"{i} " + "w " * 40, "a") for i in range(400)], "doc_id long, text string, source string")
    rows = mix_sources(df, shard_words=2_000).collect()
    assert len(rows) == 400 and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 64 * 20
    assert len({r["taken"] for r in rows}) > 1
