"""What queries shuffle, write and read at once, and that results stay as plain versions have them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from factweave.operators import sessions as S


def shuffled(spark, work) -> int:
    """Rows that ``work`` writes to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    work()
    return sum(n for k, n in rows().items() if k not in before)


def _dense(spark, n):
    """n sessions and n assisted commits, all in one minute."""
    sessions = spark.range(n).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("sid"), F.lit(60_000_000).cast("long").alias("start_ts"), (F.lit(60_010_000) + F.col("id")).cast("long").alias("end_ts"))
    commits = spark.range(n).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.lit(-1).cast("long").alias("user_id"), F.lit(60_005_000).cast("long").alias("ts"), F.lit(True).alias("assisted"))
    outputs = sessions.select(F.col("user_id").alias("out_id"), "user_id", "sid", F.sha1(F.col("user_id").cast("string").cast("binary")).alias("result"))
    return sessions, commits, outputs


@pytest.mark.parametrize("what", ["find", "attach"])
def test_pairs_are_not_shuffled(spark, what):
    """of 160,000 pairs only those that may have two strategies, about one in 64, are shuffled."""
    sessions, commits, outputs = _dense(spark, 400)
    ids, tagged = commits.select("id", F.lit(None).cast("string").alias("change_id")).limit(0), commits.select(F.lit("commit").alias("target_type"), F.col("id").alias("target_value")).limit(3)
    out = []

    def work():
        df = S.find_commits(sessions, commits, outputs) if what == "find" else S.attach_found(sessions, commits, outputs, ids, tagged)
        out.append(len(df.collect()))

    assert shuffled(spark, work) < 40_000
    assert out == [400 * 400 if what == "find" else 400 * 397]


def test_find_commits_with_repeats(spark):
    """sessions and commits that are listed twice, nulls, commits that share a change id."""
    r = random.Random(5)
    users = [1, 2, 3, None]
    sessions = [(r.choice(users), r.randint(1, 3), a := r.randint(0, 40) * 100_000, a + r.randint(0, 5) * 60_000) for _ in range(60)]
    commits = [(f"{r.randint(1, 25):07x}" + "0" * 33, r.choice(users), r.randint(0, 45) * 100_000, r.choice([True, False, False, None])) for _ in range(50)]
    outputs = [(n, *r.choice(sessions)[:2], r.choice(commits)[0]) for n in range(25)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    s, c, o = frame(sessions, "user_id long, sid long, start_ts long, end_ts long"), frame(commits, "id string, user_id long, ts long, assisted boolean"), frame(outputs, "out_id long, user_id long, sid long, result string")
    near = S.range_matches(s, c)
    ranked = [("output", S.session_outputs(o, c)), ("assisted", near.where("assisted")), ("author", near.where("same_author"))]
    whole = S.by_priority(ranked, S.asof_fallback(s, c))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(S.find_commits(s, c, o)) == plain(whole)
    ids = c.select("id", F.expr("'I' || cast(ascii(substring(id, 7, 1)) % 4 as string)").alias("change_id")).where("change_id != 'I1'").distinct()
    tagged = frame([("change-id", "I2"), ("commit", commits[0][0])], "target_type string, target_value string")
    assert plain(S.attach_found(s, c, o, ids, tagged)) == plain(S.attach(whole, ids, tagged))


def test_sessions_are_dealt_out_once(spark):
    """F2 (j15): sessions are shuffled a few times in all, however many cells of time they cover."""
    n = 20_000
    sessions = spark.range(n).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("sid"), (F.col("id") * 100_003 % 86_400_000).alias("start_ts")).withColumn("end_ts", F.col("start_ts") + 100_000)
    commits = spark.range(100).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.lit(-1).cast("long").alias("user_id"), (F.col("id") * 864_000).alias("ts"), F.lit(True).alias("assisted"))
    outputs = sessions.limit(0).select(F.col("user_id").alias("out_id"), "user_id", "sid", F.lit("").alias("result"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: S.find_commits(sessions, commits, outputs).collect()) < 9 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_targets_are_settled_in_few_shuffles(spark):
    """F1 (j16): what is known of commits is found by windows, and commits meet sessions once where no target is shared."""
    n = 20_000
    commits = spark.range(n).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("id"), F.lit(-1).cast("long").alias("user_id"), (F.col("id") * 1000).alias("ts"), F.lit(True).alias("assisted"))
    sessions = spark.range(20).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("sid"), F.lit(7 * 10**6).cast("long").alias("start_ts"), F.lit(7 * 10**6).cast("long").alias("end_ts"))
    outputs = sessions.limit(0).select(F.col("user_id").alias("out_id"), "user_id", "sid", F.lit("").alias("result"))
    ids, tagged = commits.select("id", F.concat(F.lit("I"), "id").alias("change_id")).limit(5), commits.select(F.lit("commit").alias("target_type"), F.col("id").alias("target_value")).limit(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: S.attach_found(sessions, commits, outputs, ids, tagged).collect()) < 10 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_matches_like_a_nested_loop(spark, monkeypatch):
    """F2 (j15): short and long times at the borders of hours, before 1970, turned round; crowded hours, small blocks."""
    monkeypatch.setattr(S, "CROWD", 3)
    monkeypatch.setattr(S, "BLOCK", 2)
    r, hour = random.Random(6), 64 * 60_000
    at = lambda: r.randint(-3, 4) * hour + r.choice([-1, 0, 1, 59_999, 60_000, r.randrange(hour)])
    sessions = [(r.choice([1, 2, None]), n, a := at(), a + r.choice([0, 1, 59_999, hour, 9 * hour, 10**9, -400_000, -10])) for n in range(80)]
    commits = [(f"c{n}", r.choice([1, 2, None]), r.choice([at(), *(s[r.choice([2, 3])] + r.choice([-60_001, -60_000, 300_000, 300_001]) for s in sessions[:9])]), r.choice([True, True, False, None])) for n in range(120)]
    got = S.range_matches(spark.createDataFrame(sessions, "user_id long, sid long, start_ts long, end_ts long"), spark.createDataFrame(commits, "id string, user_id long, ts long, assisted boolean"))
    want = [(u, s, c, bool(x), u == v, t) for u, s, a, b in sessions for c, v, t, x in commits if a - 60_000 <= t <= b + 300_000 and (x or u is not None and u == v)]
    assert len(want) > 500 and sorted(map(str, (tuple(g) for g in got.collect()))) == sorted(map(str, want))


def test_find_commits_of_crowds(spark, monkeypatch):
    """sessions that name more commits than they carry, crowded hours and small blocks; times of under a minute."""
    for name, n in (("MANY", 1), ("CROWD", 4), ("BLOCK", 2)):
        monkeypatch.setattr(S, name, n)
    test_find_commits_with_repeats(spark)
    s = spark.createDataFrame([(1, 1, 99_965_000, 99_650_000), (2, 1, 100_000_000, 99_000_000)], "user_id long, sid long, start_ts long, end_ts long")
    c = spark.createDataFrame([(f"{n:040x}", u, ts, a) for n, (u, ts, a) in enumerate([(9, 99_901_000, True), (9, 99_930_000, True), (9, 99_955_000, True), (1, 99_999_000, False), (2, 99_999_000, False)])], "id string, user_id long, ts long, assisted boolean")
    o = spark.createDataFrame([], "out_id long, user_id long, sid long, result string")
    assert sorted((r["user_id"], int(r["id"], 16), r["strategy"]) for r in S.find_commits(s, c, o).collect()) == [(1, 1, "assisted"), (2, 4, "fallback")]


def test_late_rows_of_the_last_half_hour(spark, tmp_path):
    """late rows near the end of the rows in time find no open session either."""
    from factweave.plans.catalog import ORACLE_SQL, QUERIES
    from tests.compare import oracle_rows, rows

    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 20 as decimal(18, 6)))")
    spark.range(1000).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "events.parquet").write_bytes(part.read_bytes())
    assert rows(QUERIES["t9_late_rows"](spark, str(tmp_path)).toPandas()) == oracle_rows(ORACLE_SQL["t9_late_rows"], str(tmp_path))[1]


def test_line_groups_in_blocks(spark):
    """runs go on over blocks of a file, whose lines aren't gathered in one task; gaps and nulls cut them."""
    from factweave.operators import views as V

    r = random.Random(3)
    lines, n = [], 0
    for file in range(3):
        n = -5000
        while n < 15000:
            n, who = n + (r.random() < 0.2), r.choice(["a", "b", None])
            for _ in range(r.choice([1, 2, 7000])):
                lines.append((file, n, f"c{n % 7}", who))
                n += 1
    got = V.line_groups(spark.createDataFrame(lines, "file int, line int, commit_id string, who string"), F.col("who"))
    want: list[list] = []
    for file, line, commit, who in sorted(lines, key=lambda x: x[:2]):
        if want and want[-1][0] == file and want[-1][2] + 1 == line and who is not None and want[-1][3] == who:
            want[-1][2] = line
        else:
            want.append([file, line, line, who, commit])
    assert sorted(map(tuple, got.select("file", "first", "last", "identity", "commit_id").collect()), key=str) == sorted(map(tuple, want), key=str)
    assert got.columns == ["file", "first", "last", "identity", "commit_id"]
    assert "hashpartitioning(file#" in got._jdf.queryExecution().executedPlan().toString() and "__block" in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_that_ids_share(spark):
    """commits are numbered by a hash; where ids share one, numbers are looked up, with equal results."""
    from factweave.operators.ancestry import Chains

    r = random.Random(8)
    parents = {f"c{i}": {f"c{r.randint(max(0, i - 6), i - 1)}" for _ in range(r.choice([1, 1, 2]))} if i % 17 else set() for i in range(60)}
    edges = spark.createDataFrame([(k, p) for k, ps in parents.items() for p in ps], "id string, parent string")
    above: dict[str, set] = {}
    for c in parents:
        above[c] = {c}.union(*(above[p] for p in parents[c]))
    asked = [(str(n), f"c{r.randint(0, 59)}", f"c{r.randint(0, 59)}") for n in range(80)]
    pairs = spark.createDataFrame([*asked, ("none", None, "c59"), ("gone", "zz", "c59")], "pair string, old string, new string")
    for number in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(50))):
        chains = Chains.of(edges, pairs.selectExpr("old AS id").where("old != 'zz'"), number=number)
        assert (chains.number is None) == (number is not F.xxhash64)
        got = {x["pair"]: x["is_ancestor"] for x in chains.is_ancestor(pairs).collect()}
        assert got == {p: a in above[b] for p, a, b in asked} | {"none": False, "gone": False}
        got = {x["pair"]: x["n"] for x in chains.new_each(pairs).collect()}
        assert got == {p: len(above[b] - above[a]) for p, a, b in asked} | {"none": len(above["c59"]), "gone": len(above["c59"])}
        ranks = spark.createDataFrame([(c, n) for n, c in enumerate(["c31", "c59", "c12", "c59"])], "id string, rank long")
        want = {c: min(n for n, t in enumerate(["c31", "c59", "c12"]) if c in above[t]) for c in parents if any(c in above[t] for t in ("c31", "c59", "c12"))}
        assert {x["id"]: x["rank"] for x in chains.least_reaching(ranks).collect()} == want


def test_ids_are_not_joined_to_numbers(spark):
    """for 4,000 commits in chains of four, each row of the input is shuffled a bounded number of times."""
    from factweave.operators import history as H

    edges = spark.range(4000).where("id % 4 > 0").select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("parent")).repartition(3)
    pairs = spark.range(0, 4000, 4).select(F.col("id").alias("pair"), F.col("id").cast("string").alias("old"), (F.col("id") + 3).cast("string").alias("new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: H.are_ancestors(edges, pairs).collect()) < 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pointers_within_blocks_are_not_shuffled(spark):
    """for 4,000 commits in chains of four that come in order, about seven rows a commit are shuffled, not 20."""
    from factweave.operators import history as H

    edges = spark.range(4000).where("id % 4 > 0").select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("parent")).coalesce(1)
    pairs = spark.range(0, 4000, 4).select(F.col("id").alias("pair"), F.col("id").cast("string").alias("old"), (F.col("id") + 3).cast("string").alias("new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        assert shuffled(spark, lambda: out.extend(H.new_versions_each(edges, pairs).collect())) < 40_000
        assert len(out) == 1000 and {r["n"] for r in out} == {3}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("forks", [False, True])
def test_chains_over_blocks(spark, forks):
    """chains whose commits come in any order, over several blocks, with repeated edges, with and without forks."""
    from factweave.operators.ancestry import Chains

    n = 1500
    up = lambda i: i - 1 if not forks or i % 50 else max(0, i - 75)
    lines = [(f"c{i}", f"c{up(i)}") for i in range(1, n)] * 2
    random.Random(4).shuffle(lines)
    above = [{0}]
    for i in range(1, n):
        above.append({i} | above[up(i)])
    asked = [(f"{a}-{b}", f"c{a}", f"c{b}") for a, b in [(0, n - 1), (700, 1400), (1400, 700), (149, 150), (75, 150), (n - 1, n - 1)]]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges, pairs = spark.createDataFrame(lines, "id string, parent string").repartition(5), spark.createDataFrame(asked, "pair string, old string, new string")
        chains = Chains.of(edges, named=False)
        assert {r["pair"]: r["n"] for r in chains.new_each(pairs).collect()} == {p: len(above[int(b[1:])] - above[int(a[1:])]) for p, a, b in asked}
        assert chains.members.count() == n and chains.members.select("chain", "pos").distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_a_hot_key_stay_where_they_are(spark, monkeypatch):
    """F8: routing gathers no key of very many rows in one task."""
    from factweave.operators import filters as P

    monkeypatch.setattr(P, "HOT", 100)
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "a:b").otherwise(F.concat(F.lit("c:"), F.col("id").cast("string"))).alias("key"), F.col("id").alias("value"))
    rules = spark.createDataFrame([(1, "route a:** x,y"), (2, "route c:* z")], "n int, rule string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        assert shuffled(spark, lambda: out.append(P.route(rows, rules).groupBy("dest").count().collect())) < 2000
        assert {r["dest"]: r["count"] for r in out[0]} == {"x": 2900, "y": 2900, "z": 100}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unchanged_files_are_dealt_over_all_tasks(spark, monkeypatch):
    """the second version's files aren't dealt to a fixed number of tasks."""
    from factweave.operators.versions import Store
    from factweave.plans.catalog import QUERIES

    plans, follow = [], Store.follow
    monkeypatch.setattr(Store, "follow", lambda self, *a: plans.append(a[3]._jdf.queryExecution().analyzed().toString()) or follow(self, *a))
    assert [tuple(r) for r in QUERIES["s9_is_unchanged"](spark, "/root/testdata/sf0.001").collect()] == [(True, False)]
    assert "RepartitionByExpression [path" in plans[0] and "Repartition 3" not in plans[0]


def test_a_batch_reads_open_prompts_once():
    """a session's rows of a batch cost one read of its state at most, and no frame."""
    from pyspark.sql import Row

    from factweave.streaming.watch import Gather

    class State:
        def __init__(self):
            self.rows, self.calls = [], []

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def clear(self):
            self.calls.append("clear")
            self.rows = []

        def appendList(self, rows):  # noqa: N802  Spark's name
            self.calls.append("append")
            self.rows = self.rows + rows

    state, gather = State(), Gather()
    gather.init(type("Handle", (), {"getListState": lambda self, *a: state})())
    batch = lambda *rows: [tuple(r) for r in gather.handleInputRows(("s",), iter([Row(session="s", ts=ts, seq=n, kind=kind, text=f"{kind[0]}{n}") for ts, n, kind in rows]), None)]
    assert batch((2, 2, "prompt"), (1, 1, "prompt")) == []
    got = batch((5, 6, "commit"), (3, 3, "commit"), (4, 4, "prompt"), (5, 5, "prompt"), (6, 7, "commit"), (7, 8, "prompt"))
    assert got == [("s", "c3", "p1|p2", 2), ("s", "c6", "p4|p5", 2), ("s", "c7", "", 0)]
    assert state.calls == ["append", "get", "clear", "append"] and state.rows == [("p8",)]


def test_pull_requests_meet_commits_in_parts(spark, monkeypatch):
    """the parts of an import grow with its texts, and its rows stay the same."""
    from factweave.plans.catalog import QUERIES
    from factweave.sources import importers

    whole = sorted(map(str, QUERIES["n4_import_times"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(importers, "PART", 8000)
    df = QUERIES["n4_import_times"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\(number#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert len(parts) == 1 and min(parts) > 10
    assert sorted(map(str, df.collect())) == whole


def test_merged_values_are_shuffled_once(spark):
    """of 2,000 texts on each side, a three-way merge shuffles each once to choose, and once to write."""
    from factweave.operators import merge as M

    texts = spark.range(2000).select(F.lit("path").alias("target_type"), F.col("id").cast("string").alias("target_value"), F.lit("k").alias("key"), F.lit("string").alias("value_type"), F.lit("").alias("id"), F.concat(F.lit("text"), "id").alias("value"))
    changed = lambda n: F.when(F.col("target_value") % 3 == n, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    dead = texts.where("target_value % 10 = 7").select(*M.K, F.lit(1).cast("long").alias("ts"), F.lit("a").alias("email"))
    base, local, remote = (M.Snapshot(v, dead.limit(0) if n < 2 else dead) for n, v in enumerate((texts, texts.withColumn("value", changed(1)), texts.withColumn("value", changed(2)).where("target_value % 10 < 7"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        work = lambda: out.extend(M.materialise(local.values, base, local, [("three-way", remote)]).collect())
        n = shuffled(spark, work)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {str(n): f"text{n}" + "!" * (n % 3 > 0) for n in range(2000) if n % 10 < 7 or n % 3 == 1}
    assert {r["target_value"]: r["value"] for r in out} == want and len(out) == len(want)
    assert n < 33_000
