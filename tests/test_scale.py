"""Large keys, long histories and shared versions: what a plan must not do, against plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from factweave.operators import history as H
from factweave.operators import merge as M
from factweave.operators import ordering as O
from factweave.operators import snapshot as N
from factweave.operators import state as S
from factweave.operators.ancestry import Chains
from factweave.operators.versions import Store
from factweave.plans.fixtures import frame
from tests.compare import rows

SF = "/root/testdata/sf0.001"


def big_list(spark, first, n, value="v"):
    cols = [F.lit(x).alias(c) for c, x in (("target_type", "commit"), ("target_value", "abc"), ("key", "log"), ("value_type", "list"))]
    return spark.range(first, first + n).select(*cols, F.concat(F.col("id").cast("string"), F.lit("-abcde")).alias("id"), F.concat(F.lit(value), F.col("id").cast("string")).alias("value"))


def test_merge_of_one_large_key(spark):
    """A million entries on each side, a fifth of them in both."""
    n = 1_000_000
    base, local, remote = big_list(spark, 0, 10), big_list(spark, 0, n), big_list(spark, n * 4 // 5, n, "w")
    start = time.time()
    got = M.merge3(base, local, remote).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").startswith("w")).alias("w"), F.count_distinct("id").alias("ids")).first()
    assert tuple(got) == (n * 9 // 5, n * 4 // 5, n * 9 // 5)
    assert time.time() - start < 60  # 32,000 entries took three minutes once
    assert M.merge_breakdown(base, local, remote).first()["conflicts"] == 1
    plan = M.decisions(base, local, remote)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortAggregate" not in plan


def test_digests_tell_items_apart(spark):
    put = lambda *items: spark.createDataFrame([("path", "src", "k", "list", i, v) for i, v in items], "target_type string, target_value string, key string, value_type string, id string, value string")
    one = [("a", "x"), ("b", "y"), ("c", None)]
    for other in ([("a", "y"), ("b", "x"), ("c", None)], one[:2], [("a", "x"), ("b", "y"), ("c", "")], [*one, ("a", "x")], [("ax", ""), ("b", "y"), ("c", None)]):
        assert M.ff_delta(put(*one), put(*other)).first()["changed"] == 1
    assert M.ff_delta(put(*one), put(*one[::-1])).first()["changed"] == 0


def test_two_way_merge_prefers_a_side(spark):
    v = "target_type string, target_value string, key string, value_type string, id string, value string"
    t = "target_type string, target_value string, key string, ts long, email string"
    side = lambda x, dead: M.Snapshot(spark.createDataFrame([("path", "s", k, "string", "", val) for k, val in x.items()], v), spark.createDataFrame([("path", "s", k, ts, "e") for k, ts in dead.items()], t))
    local, remote = side({"a": "1", "b": "1", "c": "1"}, {"d": 5, "e": 5}), side({"a": "2", "b": "1", "d": "2", "f": "2"}, {"c": 7, "e": 6})
    got = M.merge2(local, remote)
    assert {r["key"]: r["value"] for r in got.values.collect()} == {"a": "1", "b": "1", "c": "1", "f": "2"}
    assert {r["key"]: r["ts"] for r in got.tombstones.collect()} == {"d": 5, "e": 5}
    assert {r["key"] for r in M.decisions2(local, remote).where("conflict").collect()} == {"a", "c", "d", "e"}
    other = M.merge2(local, remote, "remote")
    assert {r["key"]: r["value"] for r in other.values.collect()} == {"a": "2", "b": "1", "d": "2", "f": "2"}


def names(path):
    return sorted(os.path.join(d, f)[len(path) :] for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))


def test_versions_share_what_did_not_change(spark, tmp_path):
    """A following version writes the buckets of touched targets, reads no other, and names the rest."""
    store = Store(spark, f"file://{tmp_path}/s", buckets=32, leaves=256)
    snap = M.Snapshot(frame(spark, SF, "local"), frame(spark, SF, "tomb_local"))
    files = N.render_snapshot(snap)
    store.write(files, "v1")
    before = names(f"{tmp_path}/s")
    assert rows(store.read("v1").select("path", "content").toPandas()) == rows(files.select("path", "content").toPandas())

    one = snap.values.select("target_type", "target_value").distinct().orderBy("target_value").limit(1)
    newer = M.Snapshot(snap.values.withColumn("value", F.concat("value", F.lit("+"))), snap.tombstones)
    log = one.withColumn("ts", F.lit(9))
    changed = N.export_incremental(store, "v1", "v2", newer, log, 5)
    assert len(changed) == 1
    assert set(before) <= set(names(f"{tmp_path}/s"))
    added = [f for f in names(f"{tmp_path}/s") if f not in before and "/manifests/" not in f]
    assert added and all(f"/v2/bucket={changed[0]}/" in f for f in added)
    clean = {b: at for b, (at, _) in store.manifest("v2").items() if b not in changed}
    assert clean == {b: at for b, (at, _) in store.manifest("v1").items() if b not in changed}

    # clean buckets aren't read: the next version can be made without their files
    for b, at in clean.items():
        os.rename(f"{tmp_path}/s/files/{at}", f"{tmp_path}/away-{b}")
    twice = M.Snapshot(newer.values.withColumn("value", F.concat("value", F.lit("+"))), snap.tombstones)
    assert N.export_incremental(store, "v2", "v3", twice, log, 5) == changed
    assert store.diff("v2", "v3").count() > 0 and not store.unchanged("v2", "v3")
    for b, at in clean.items():
        os.rename(f"{tmp_path}/away-{b}", f"{tmp_path}/s/files/{at}")

    want = files.join(one, ["target_type", "target_value"], "left_anti").select("path", "content")
    want = want.unionByName(N.render_snapshot(twice).join(one, ["target_type", "target_value"], "left_semi").select("path", "content"))
    assert rows(store.read("v3").select("path", "content").toPandas()) == rows(want.toPandas())
    assert N.export_incremental(store, "v3", "v4", twice, log, 5) == [] and not store.exists("v4")  # nothing new


def test_versions_lose_and_gain_targets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8, leaves=64)
    make = lambda d: spark.createDataFrame([(f"{t}/k{i}", v, "path", t) for t, vs in d.items() for i, v in enumerate(vs)], "path string, content string, target_type string, target_value string")
    store.write(make({f"t{i}": ["a", "b"] for i in range(20)}), "1")
    dirty = make({"t3": [""], "new": [""]})
    store.follow("1", "2", dirty, make({"new": ["x"], "t5": ["not dirty"]}))
    assert {(r["path"], r["status"]) for r in store.diff("1", "2").collect()} == {("t3/k0", "D"), ("t3/k1", "D"), ("new/k0", "A")}
    assert {(r["path"], r["status"]) for r in store.diff("2", "1").collect()} == {("t3/k0", "A"), ("t3/k1", "A"), ("new/k0", "D")}
    assert store.diff("1", "1").isEmpty()
    store.follow("2", "3", make({"new": [""]}), make({"new": ["y"]}))
    assert [tuple(r) for r in store.diff("2", "3", contents=True).collect()] == [("new/k0", "M", "y")]
    assert [tuple(r) for r in store.diff("1", "3").where("status = 'A'").collect()] == [("new/k0", "A")]


def test_changes_bring_a_state_up_to_date(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8, leaves=64)
    of = lambda side: M.Snapshot(frame(spark, SF, side), frame(spark, SF, f"tomb_{side}"))
    store.write(N.render_snapshot(of("local")), "a")
    store.write(N.render_snapshot(of("remote")), "b")
    got = N.apply_changes(of("local").values, store.diff("a", "b", contents=True))
    assert rows(got.select(*M.VALUES).toPandas()) == rows(of("remote").values.select(*M.VALUES).toPandas())


def random_history(n, merges, seed):
    rng = random.Random(seed)
    parents = {0: []}
    for i in range(1, n):
        near = [rng.randrange(max(0, i - 6), i)]
        if rng.random() < merges:
            near.append(rng.randrange(max(0, i - 12), i))
        parents[i] = sorted(set(near)) if rng.random() > 0.03 else []
    return parents


def reach(parents):
    up = {}
    for i, ps in parents.items():
        up[i] = {i}.union(*(up[p] for p in ps))
    return up


@pytest.mark.parametrize("seed,n,merges", [(2, 120, 0.1), (3, 50, 0.8)])
def test_chain_labels(spark, seed, n, merges):
    """Common ancestors, counts and oldest tags of graphs with merges, several roots and criss-crosses."""
    parents = random_history(n, merges, seed)
    up, rng = reach(parents) | {"x": {"x"}}, random.Random(seed)  # a head without parents is a commit, too
    edges = spark.createDataFrame([(f"c{i}", f"c{p}") for i, ps in parents.items() for p in ps], "id string, parent string")
    asked = [(f"p{k}", rng.randrange(n), rng.randrange(n)) for k in range(50)] + [("none", 3, None), ("strange", 3, "x")]
    name = lambda i: None if i is None else f"c{i}"
    pairs = spark.createDataFrame([(p, name(a), name(b)) for p, a, b in asked], "pair string, local string, remote string")
    best = {}
    for p, a, b in asked:
        common = up[a] & up.get(b, set())
        tops = [c for c in common if not any(c != d and c in up[d] for d in common)]
        if tops:
            best[p] = min(f"c{c}" for c in tops)
    chains = Chains.of(edges, pairs.select(F.col("remote").alias("id")).where("id IS NOT NULL"))
    for window in (1, 1024):
        assert {r["pair"]: r["base"] for r in chains.best_common(pairs, window).collect()} == best
    way = pairs.select("pair", F.col("local").alias("old"), F.col("remote").alias("new"))
    assert {r["pair"]: r["n"] for r in chains.new_each(way).collect()} == {p: len(up.get(b, set()) - up[a]) for p, a, b in asked}
    assert {r["pair"]: r["is_ancestor"] for r in chains.is_ancestor(way).collect()} == {p: a in up.get(b, set()) for p, a, b in asked}
    tags = {f"c{rng.randrange(n)}": k for k in range(12)}
    ranks = spark.createDataFrame(list(tags.items()), "id string, rank int")
    want = {f"c{i}": min((k for c, k in tags.items() if i in up[int(c[1:])]), default=None) for i in parents}
    assert {r["id"]: r["rank"] for r in chains.least_reaching(ranks).collect()} == {i: k for i, k in want.items() if k is not None}


def test_labels_of_a_long_history(spark):
    """A main line with a merged branch every ten commits: a label for each chain, not for each ancestor."""
    n = 3000
    main = spark.range(1, n).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("m"), (F.col("id") - 1).cast("string")).alias("parent"))
    side = spark.range(10, n, 10).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("b"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("at"), F.concat(F.lit("m"), (F.col("id") - 5).cast("string")).alias("from"))
    edges = main.unionByName(side.select(F.col("at").alias("id"), F.col("b").alias("parent"))).unionByName(side.select(F.col("b").alias("id"), F.col("from").alias("parent")))
    chains = Chains.of(edges)
    heads = spark.createDataFrame([(i, f"m{n - 1 - i}") for i in range(5)], "head long, id string")
    labels = chains.labels(heads)
    assert labels.count() <= 5 * (n // 10 + 1) and chains.members.count() == n + n // 10 - 1
    pairs = spark.createDataFrame([(f"p{k}", f"b{k}", f"m{n - 1}") for k in range(10, n, 100)], "pair string, local string, remote string")
    assert all(r["base"] == "b" + r["pair"][1:] for r in H.merge_bases(edges, pairs).collect())


def one_key(spark, n, **cols):
    base = {"target_type": F.lit("commit"), "target_value": F.lit("abc"), "key": F.lit("log"), "value_type": F.lit("list"), "idx": F.lit(None).cast("int"), "email": F.lit("e")}
    return spark.range(n).select(F.col("id").alias("seq"), *(c.alias(k) for k, c in (base | cols).items()))


def test_times_of_one_large_key_spread_over_tasks(spark):
    m = one_key(spark, 200_000, op=F.lit("push"), value=F.lit("v"), ts=(F.col("id") * 7919 % 100_003))
    got = [r["ts"] for r in S.bumped(m, [F.col("seq")]).orderBy("seq").select("ts").collect()]
    last, want = None, []
    for i in range(200_000):
        last = max(i * 7919 % 100_003, (last if last is not None else -1) + 1)
        want.append(last)
    assert got == want
    parts = O.spread(m, S.K, [F.col("seq")]).groupBy("__part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 100_000


def test_pops_of_one_large_value(spark):
    """One value pushed and popped again and again: as one replay of the log has it."""
    pop = F.xxhash64("id") % 5 > 0
    m = one_key(spark, 20_000, op=F.when(pop & (F.col("id") % 3 < 2), "pop").otherwise("push"), value=F.lit("v"), ts=F.col("id") * 2).where("seq > 0 or op = 'push'")
    m = m.withColumn("op", F.when(F.col("seq") == 0, "push").otherwise(F.col("op")))
    entries, rejects = S.fold_list_pop(m)
    stack, ts, missed = [], -1, []
    for r in m.orderBy("seq").collect():
        if r["op"] == "push":
            ts = max(r["ts"], ts + 1)
            stack.append(ts)
        elif stack:
            stack.pop()
        else:
            missed.append(r["seq"])
    assert sorted(r["ts"] for r in entries.collect()) == sorted(stack)
    assert sorted(r["seq"] for r in rejects.collect()) == missed


@pytest.mark.parametrize("how,before,backward", [("max", False, False), ("min", True, False), ("sum", False, False), ("sum", True, True), ("min", True, True)])
def test_scan(spark, how, before, backward):
    rng = random.Random(9)
    data = [(rng.choice("aaab") if i > 5 else "c", i, rng.randrange(50) if rng.random() > 0.2 else None) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    order = [F.col("i")]
    got = {r["i"]: r["x"] for r in O.scan(O.spread(df, ["g"], order), ["g"], order, F.col("v"), "x", how, before, backward).collect()}
    fold = {"max": max, "min": min, "sum": sum}[how]
    for g, i, _ in data:
        past = [v for h, j, v in data if h == g and v is not None and ((j > i or j == i and not before) if backward else (j < i or j == i and not before))]
        assert got[i] == (fold(past) if past else 0 if how == "sum" and got[i] == 0 else None)


def matches(pattern, key):
    if not pattern:
        return not key
    if pattern[0] == "**":
        return matches(pattern[1:], key) or bool(key) and matches(pattern, key[1:])
    return bool(key) and (pattern[0] == "*" or pattern[0] == key[0]) and matches(pattern[1:], key[1:])


def test_routing_by_trie(spark):
    """Random rules against the words of their definition; many stars, shared beginnings, deep keys."""
    from factweave.operators import filters as P

    rng = random.Random(2)
    word = lambda stars: rng.choice(["a", "b", "c", "", "é"] + ["*", "**"] * stars)
    for most in (3, 30):
        patterns = [":".join(word(2) for _ in range(rng.randint(1, 5))) for _ in range(most)] + ["draft:**", "x*:y"]
        texts = [f"exclude {p}" if k % 5 == 4 else f"route {p} d{k % 4},e{k % 3}" for k, p in enumerate(patterns)] + ["route", "other a b", "route a"]
        keys = {":".join(word(0) for _ in range(rng.randint(1, 7))) for _ in range(120)} | {"draft", "draft:x:y", "x1:y", "meta:local:a", "a:" * 40 + "b"}
        want = set()
        for key in keys - {"meta:local:a"}:
            hit = [t.split() for t, p in zip(texts, patterns, strict=False) if matches(p.split(":"), key.split(":"))]
            if not any(t[0] == "exclude" for t in hit):
                dests = {d for t in hit for d in t[2].split(",")}
                want |= {(key, d) for d in dests or {"main"}}
        rules = spark.createDataFrame(list(enumerate(texts)), "n int, rule string")
        got = P.classify(spark.createDataFrame([(k,) for k in keys], "key string"), rules)
        assert {tuple(r) for r in got.collect()} == want


def test_many_rules_need_no_nested_loop(spark):
    from factweave.operators import filters as P

    rules = spark.range(20_000).select(F.col("id").alias("n"), F.concat(F.lit("route ns"), F.col("id").cast("string"), F.lit(":*:k:** d"), (F.col("id") % 7).cast("string")).alias("rule"))
    keys = spark.range(50_000).select(F.concat(F.lit("ns"), (F.col("id") % 30_000).cast("string"), F.lit(":x"), F.col("id").cast("string"), F.lit(":k")).alias("key"))
    got = P.classify(keys, rules)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    counts = {r["dest"]: r["count"] for r in got.groupBy("dest").count().collect()}
    assert sum(counts.values()) == 50_000 and counts["main"] == sum(i % 30_000 >= 20_000 for i in range(50_000))


def test_fuzzy_is_linear(spark):
    """A term that doesn't occur costs one pass over a long text; special characters are plain ones."""
    from factweave.operators import filters as P

    data = [("path", "t", "k", "ea" * 100_000), ("path", "t", "k2", "e\nA\nz"), ("path", "a.b[c]\\^-é", "k3", None)]
    facts = spark.createDataFrame(data, "target_type string, target_value string, key string, value string")
    found = lambda term: {r["key"] for r in P.fuzzy(facts, "path", term).collect()}
    start = time.time()
    assert found("eaz") == {"k2"} and time.time() - start < 20
    assert found(".[]\\^-É") == {"k3"} and found("") == {"k", "k2", "k3"} and found("k2") == {"k2"}


def test_entries_like_a_plain_list():
    rng = random.Random(8)
    for values in ("v", "abc", "abcdefghijklmnop"):
        have, want = S.Entries(), []
        for i in range(6000):
            kind = rng.random() if i < 4000 else 0.5 + rng.random() / 2
            if kind < 0.55 or not want:
                e = (rng.choice(values), i)
                have.append(*e)
                want.append(e)
            elif kind < 0.8:
                v = rng.choice(values)
                at = max((n for n, e in enumerate(want) if e[0] == v), default=None)
                assert have.pop_value(v) == (at is not None)
                if at is not None:
                    del want[at]
            else:
                n = rng.randrange(len(want))
                assert have.pop_at(n) == want.pop(n)[0]
            assert len(have) == len(want) and have.last_ts() == (want[-1][1] if want else None)
        assert list(have) == want


def test_a_long_list_is_edited_in_seconds():
    start, have, rng = time.time(), S.Entries(), random.Random(1)
    for i in range(200_000):
        have.append("v" if i % 2 else str(i % 1000), i)
    for i in range(100_000):
        have.pop_at(rng.randrange(len(have)))
        have.pop_value("v")
    assert len(have) < 100_001 and time.time() - start < 30


def test_sessions_of_a_month_cost_few_cells(spark):
    from factweave.operators import sessions as X

    rng = random.Random(4)
    spans = [(0, 1), (5, 6), (-7, 9), (1, 2**20 + 3), (2**40 - 1, 2**40 + 43_201)] + [(a := rng.randrange(-(10**6), 10**6), a + rng.randrange(1, 5000)) for _ in range(40)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", X.dyadic_cells(F.col("a"), F.col("b")).alias("cells"))
    for r in df.collect():
        covered = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in r["cells"])
        assert covered[0][0] == r["a"] and covered[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        assert len(covered) <= 64
    at = [(f"s{i}", i % 3, t, t + rng.choice([10**4, 10**7, 2 * 10**9])) for i, t in enumerate(rng.randrange(10**9) for _ in range(30))]
    done = [(f"c{i}", rng.randrange(3), rng.randrange(2 * 10**9), rng.random() < 0.3, i % 2) for i in range(200)]
    sessions = spark.createDataFrame([(u, s, a, b, u % 2) for s, u, a, b in at], "user_id int, sid string, start_ts long, end_ts long, project int")
    commits = spark.createDataFrame(done, "id string, user_id int, ts long, assisted boolean, project int")
    for within in ((), ("project",)):
        got = {(r["sid"], r["id"]) for r in X.range_matches(sessions, commits, within=within).collect()}
        assert got == {(s, c) for s, u, a, b in at for c, v, t, x, p in done if a - 60_000 <= t <= b + 300_000 and (x or u == v) and (not within or u % 2 == p)}


def test_nested_json_by_directory(spark, tmp_path):
    import json

    from factweave.operators import views as V

    data = [("path", f"{top}/f{i}", k, f"é\n{i}") for top in ("src", "lib") for i in range(5) for k in ("a:b", "c")] + [("path", "README", "a", '"'), ("commit", "abc", "x:y", "1"), ("commit", "def", "x", "2")]
    facts = spark.createDataFrame(data, "target_type string, target_value string, key string, value string")
    V.write_nested_json(facts, f"{tmp_path}/out")
    got = {}
    for r in V.read_nested_json(spark, f"{tmp_path}/out").collect():
        got.setdefault(r["target_type"], []).append(json.loads(r["json"]))
    assert sorted(map(len, got["path"])) == [1, 5, 5] and len(got["commit"]) == 2
    whole = {k: v for one in got["path"] for k, v in one.items()}
    assert whole == {t: {k: v for _, u, k, v in data if u == t} for kind, t, _, _ in data if kind == "path"}
    assert {"abc": {"x": {"y": "1"}}} in got["commit"]
