"""Small cases with known answers, and properties that hold for all snapshots."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import scalars as C
from factweave.operators import filters as P
from factweave.operators import history as H
from factweave.operators import merge as M
from factweave.operators import snapshot as N
from factweave.operators import state as S
from factweave.plans.fixtures import frame
from tests.compare import rows

SF = "/root/testdata/sf0.001"
V = "target_type string, target_value string, key string, value_type string, id string, value string"
MUT = "seq long, target_type string, target_value string, key string, op string, value string, value_type string, idx int, email string, ts long"


def strings(spark, **values):
    return spark.createDataFrame([("path", "src", k, "string", "", v) for k, v in values.items()], V)


def log(spark, *ops):
    full = [(i, "commit", "abc123", k, op, v, t, idx, "a@example.com", ts) for i, (k, op, v, t, idx, ts) in enumerate(ops)]
    return spark.createDataFrame(full, MUT)


def by_key(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_three_way_strings(spark):
    b, l, r = strings(spark, s="draft", gone="x", kept="y"), strings(spark, s="archived", kept="y"), strings(spark, s="published", gone="x2", kept="y", new="n")
    assert by_key(M.merge3(b, l, r)) == {"s": "archived", "gone": "x2", "kept": "y", "new": "n"}
    assert {(c["key"], c["reason"], c["resolution"]) for c in M.conflicts(b, l, r).collect()} == {("s", "both-changed", "local"), ("gone", "remote-modified-local-removed", "remote")}
    assert by_key(M.merge3(b, l, r, prefer="remote"))["s"] == "published"


def test_merge_identities(spark):
    b, l, r = (frame(spark, SF, n) for n in ("base", "local", "remote"))
    same = lambda x, y: rows(x.select(*M.VALUES).toPandas()) == rows(y.select(*M.VALUES).toPandas())
    assert same(M.merge3(b, b, r), r)
    assert same(M.merge3(b, l, b), l)
    assert same(M.merge3(l, l, l), l) and M.conflicts(l, l, l).isEmpty()


def test_equal_concurrent_adds_conflict(spark):
    none, x = strings(spark, z="1").where("false"), strings(spark, k="v")
    assert [c["reason"] for c in M.conflicts(none, x, x).collect()] == ["concurrent-add"]


def test_export_import_is_identity(spark):
    local = frame(spark, SF, "local")
    back = N.parse_snapshot(N.render_snapshot(M.Snapshot(local)))
    assert rows(back.values.toPandas()) == rows(local.toPandas())


def test_list_tombstone_paths_are_parsed(spark):
    files = spark.createDataFrame([("project/k/__list/__tombstones/5-abcde", '{"timestamp":7,"email":"e"}'), ("project/k/__list/__tombstones/6-abcde", "bad"), ("nowhere/x", "y")], "path string, content string")
    got = N.parse_snapshot(files)
    assert [tuple(r) for r in got.list_tombstones.select("key", "id", "ts").collect()] == [("k", "5-abcde", 7)]
    assert got.values.isEmpty()


@pytest.mark.parametrize("key,error", [("a:b", None), ("a::b", "empty"), ("", "empty"), ("..:a", "dots"), ("a/b", "slash"), ("x:__set", "reserved")])
def test_key_error(spark, key, error):
    assert spark.range(1).select(C.key_error(F.lit(key))).first()[0] == error


def test_glob_patterns(spark):
    cases = [("draft:**", "draft", True), ("draft:**", "draft:a:b", True), ("a:*", "a:b", True), ("a:*", "a:b:c", False), ("a*:b", "ax:b", False), ("**:x", "x", True)]
    df = spark.createDataFrame(cases, "p string, k string, want boolean")
    got = df.select(F.regexp_like(F.concat("k", F.lit(":")), C.pattern_regex("p")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_local_keys_never_leave(spark):
    keys = spark.createDataFrame([("meta:local:x",), ("meta:local",), ("a",)], "key string")
    rules = spark.createDataFrame([(1, "route ** out")], "n int, rule string")
    assert {r["key"] for r in P.classify(keys, rules).collect()} == {"meta:local", "a"}


def test_list_timestamps_increase(spark):
    m = log(spark, *[("k", "push", str(i), "list", None, ts) for i, ts in enumerate((1000, 1000, 900, 5000, 4000))])
    assert sorted(r["ts"] for r in S.fold_list_push(m).collect()) == [1000, 1001, 1002, 5000, 5001]


def test_set_remove_then_add_clears_tombstone(spark):
    m = log(spark, ("k", "set_add", "a", "set", None, 1), ("k", "set_rm", "a", "set", None, 2), ("k", "set_add", "a", "set", None, 3))
    live, dead = S.fold_set(m)
    assert [r["ts"] for r in live.collect()] == [3] and dead.isEmpty()


def test_sequential_fold(spark):
    m = log(spark, ("k", "push", "a", "list", None, 1000), ("k", "push", "b", "list", None, 1000), ("k", "pop", "b", "list", None, 1), ("k", "push", "c", "list", None, 1000),
            ("k", "list_rm", None, "list", 0, 5), ("k", "list_rm", None, "list", 9, 6), ("k", "set_add", "x", "set", None, 7))
    got = {(r["part"], r["value"], r["ts"]) for r in S.replay(m).collect()}
    assert got == {("entry", "c", 1001), ("entry_tombstone", "a", 5), ("reject", "IndexOutOfRange", None), ("reject", "TypeMismatch", None)}


def test_native_and_sequential_folds_agree(spark):
    """All parts, rejects among them."""
    m = frame(spark, SF, "mut")
    cols = ["target_value", "key", "part", "value", "ts"]
    every = lambda df: rows(df.select(*cols, F.when(F.col("part") == "reject", F.col("seq")).alias("seq")).toPandas())
    assert every(S.replay(m)) == every(S.fold_in_order(m))


def plain_replay(ops):
    """One key's operations, by the words of their definition: (part, value, ts) of what is left."""
    kind, text, entries, members, dead, gone, cut, rejects = None, None, [], {}, {}, None, [], []
    for r in sorted(ops, key=lambda r: r["seq"]):
        op, v, ts = r["op"], r["value"], r["ts"]
        wanted = {"push": "list", "pop": "list", "list_rm": "list", "set_add": "set", "set_rm": "set"}.get(op)
        starts = op in ("push", "set_add")
        if op == "set" and r["value_type"] == "string":
            kind, text, entries, members, dead, gone = "string", (v, ts), [], {}, {}, None
        elif op == "rm":
            if kind:
                kind, entries, members, cut, gone = None, [], {}, [], ts
        elif kind is None and not starts:
            rejects.append((r["seq"], "KeyNotFound"))
        elif kind not in (None, wanted) and not (op == "push" and kind == "string"):
            rejects.append((r["seq"], "TypeMismatch"))
        elif op == "push":
            entries = [(text[0], 0)] if kind == "string" else entries
            kind, gone = "list", None
            entries = [*entries, (v, max(ts, entries[-1][1] + 1) if entries else ts)]
        elif op == "pop":
            places = [i for i, e in enumerate(entries) if e[0] == v]
            if places:
                entries = entries[: places[-1]] + entries[places[-1] + 1 :]
            else:
                rejects.append((r["seq"], "ValueNotFound"))
        elif op == "list_rm":
            if 0 <= r["idx"] < len(entries):
                cut.append((entries[r["idx"]][0], ts))
                entries = entries[: r["idx"]] + entries[r["idx"] + 1 :]
            else:
                rejects.append((r["seq"], "IndexOutOfRange"))
        elif op == "set_add":
            kind, gone = "set", None
            members[v] = ts
            dead.pop(v, None)
        elif v in members:
            del members[v]
            dead[v] = ts
        else:
            rejects.append((r["seq"], "ValueNotFound"))
    out = [("value", *text)] if kind == "string" else []
    out += [("entry", *e) for e in entries] + [("member", *m) for m in members.items()] + [("member_tombstone", *m) for m in dead.items()] + [("entry_tombstone", *c) for c in cut]
    return out + ([("tombstone", None, gone)] if gone is not None else []) + [("reject", reason, seq) for seq, reason in rejects]


@pytest.mark.parametrize("how", ["queue", "removed", "mixed"])
def test_replay_of_all_keys(spark, how):
    """Whole tables against a plain replay of every key: lists, removals by index, and all kinds of
    operations on the same keys."""
    m = frame(spark, SF, "mut" if how == "mixed" else "queue")
    if how == "removed":
        m = m.withColumn("op", F.when(F.col("seq") % 5 == 0, "list_rm").otherwise(F.col("op"))).withColumn("idx", (F.col("seq") % 3).cast("int"))
    if how == "mixed":
        m = m.withColumn("key", F.concat(F.lit("k"), (F.col("seq") % 2).cast("string")))
    keys = {}
    for r in m.collect():
        keys.setdefault((r["target_value"], r["key"]), []).append(r)
    want = sorted(str((*k, *x)) for k, ops in keys.items() for x in plain_replay(ops))
    ts = F.when(F.col("part") == "reject", F.col("seq")).otherwise(F.col("ts"))
    got = sorted(str(tuple(r)) for r in S.replay(m).select("target_value", "key", "part", "value", ts.alias("ts")).collect())
    assert got == want


def test_removals_from_keys_that_never_were(spark):
    m = log(spark, ("a", "pop", "x", "list", None, 1), ("b", "set_rm", "x", "set", None, 2), ("c", "push", "y", "list", None, 3), ("c", "pop", "x", "list", None, 4),
            ("d", "set_rm", "z", "set", None, 5), ("d", "set_add", "y", "set", None, 6), ("d", "set_rm", "x", "set", None, 7))
    want = {("a", "KeyNotFound"), ("b", "KeyNotFound"), ("c", "ValueNotFound"), ("d", "KeyNotFound"), ("d", "ValueNotFound")}
    for out in (S.replay(m), S.fold_in_order(m)):
        assert {(r["key"], r["value"]) for r in out.where("part = 'reject'").collect()} == want


def test_reachability_of_a_merge(spark):
    e = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "id string, parent string")
    pairs = spark.createDataFrame([("1", "b", "c"), ("2", "d", "d"), ("3", "b", "d"), ("4", "b", "z")], "pair string, local string, remote string")
    got = {r["pair"]: (r["strategy"], r["base"]) for r in H.merge_strategies(e, pairs).collect()}
    assert got == {"1": ("three-way", "a"), "2": ("up-to-date", None), "3": ("fast-forward", None), "4": ("two-way", None)}
    assert H.new_versions(e, "b", "d").first()["n"] == 2
    named = spark.createDataFrame([("x" * 2000 + "1", "b", "d"), ("x" * 2000 + "2", None, "b"), ("z", "d", "a")], "pair string, old string, new string")
    assert sorted((r["pair"][-1], r["n"]) for r in H.new_versions_each(e, named).collect()) == [("1", 2), ("2", 2), ("z", 0)]


def test_best_common_ancestor(spark):
    """A nearer common ancestor that the better one reaches is not the base; without a local head the
    remote one is taken over; long names stay apart."""
    e = spark.createDataFrame([("l", "A"), ("l", "x"), ("x", "B"), ("r", "A"), ("r", "y"), ("y", "B"), ("B", "A")], "id string, parent string")
    long = "p" * 3000
    pairs = spark.createDataFrame([("1", "l", "r"), ("2", None, "r"), (long + "a", "A", "l"), (long + "b", "l", "A")], "pair string, local string, remote string")
    got = {r["pair"]: (r["strategy"], r["base"]) for r in H.merge_strategies(e, pairs).collect()}
    assert got == {"1": ("three-way", "B"), "2": ("fast-forward", None), long + "a": ("fast-forward", None), long + "b": ("three-way", "A")}


def test_oldest_tag_wins(spark):
    c = spark.createDataFrame([(str(i), [str(i - 1)] if i else []) for i in range(9)], "id string, parents array<string>")
    tags = spark.createDataFrame([("v1", "3", 10), ("v2", "8", 20)], "name string, commit_id string, created long")
    got = {r["commit_id"]: r["tag"] for r in H.release_of(c, tags).collect()}
    assert got == {str(i): "v1" if i <= 3 else "v2" for i in range(9)}


def test_empty_tables(spark):
    none = frame(spark, SF, "base").where("false")
    assert M.merge3(none, none, none).isEmpty() and M.conflicts(none, none, none).isEmpty()
    assert S.replay(frame(spark, SF, "mut").where("false")).isEmpty()


def test_exchange_retries_on_a_moved_head(spark, tmp_path):
    from factweave.streaming import exchange as X

    x = X.Exchange(spark, f"file://{tmp_path}/x")
    X.push(x, strings(spark, a="1"))
    assert not x.commit(strings(spark, b="2"), -1)
    assert by_key(x.read(0)) == {"a": "1"}  # the loser changed nothing
    assert by_key(X.push(x, strings(spark, b="2"))) == {"a": "1", "b": "2"}
    assert x.head() == 1


def test_exchange_with_two_stores_at_once(spark, tmp_path, monkeypatch):
    """Of stores that write the same version one has it, and the other builds on that; one that dies
    before its rename is as if it hadn't been."""
    from factweave.streaming import exchange as X

    x, y = (X.Exchange(spark, f"file://{tmp_path}/x") for _ in range(2))
    X.push(x, strings(spark, a="1"))
    strings(spark, z="9").write.parquet(f"{x.path}/aside/dead")
    real, late = X.Exchange.commit, []

    def slow(self, values, parent):
        if self is y and not late:
            late.append(real(x, strings(spark, a="1", c="3"), parent))  # the other store is faster
        return real(self, values, parent)

    monkeypatch.setattr(X.Exchange, "commit", slow)
    assert by_key(X.push(y, strings(spark, b="2"))) == {"a": "1", "b": "2", "c": "3"}
    assert late == [True] and y.head() == 2
    monkeypatch.setattr(X.Exchange, "commit", lambda self, values, parent: False)
    with pytest.raises(RuntimeError, match="moved 2 times"):
        X.push(x, strings(spark, b="2"), tries=2)


def test_conventional_type_and_author(spark):
    subjects = [("feat(api)!: add", ("feat", True)), (" feat: x", ("feat", False)), ("feat : x", ("feat", False)), ("fix(a) : y", ("fix", False)), ("fix (a): y", (None, None)), ("Merge pull #1", (None, None)), (": x", (None, None)), ("\tci: x", ("ci", False))]
    df = spark.createDataFrame([(s,) for s, _ in subjects], "s string").select("s", C.conventional_type("s").alias("t")).select("s", "t.*")
    assert {r["s"]: (r["type"], r["breaking"]) for r in df.collect()} == dict(subjects)
    people = [(None, "Ann ", "Ann "), (" ", "Ann", None), ("", "Ann", None), (" a ", "Ann", " a "), (None, " ", None), (None, None, None)]
    df = spark.createDataFrame(people, "l string, n string, want string").select(C.author_identity("l", "n").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_flatten_reaches_every_depth(spark):
    from factweave.operators import views as V

    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":1}}}},"x":2,"t":"{not json"}'), (2, "{}"), (3, None)], "id long, j string")
    assert {(r["id"], r["key"], r["value"]) for r in V.flatten_json(df, "j", ["id"]).collect()} == {(1, "a:b:c:d:e", "1"), (1, "x", "2"), (1, "t", "{not json")}


def test_sessions_whose_branches_come_later(spark):
    from factweave.streaming.watch import to_last_branch

    closed = spark.createDataFrame([(1, 100, "a"), (2, 100, "b"), (3, 100, "c")], "u long, end_ms long, transcript string")
    branches = spark.createDataFrame([(1, 200, "later"), (3, 50, "x"), (3, 90, "y"), (3, 101, "z")], "u long, ts long, branch string")
    assert {(r["u"], r["branch"]) for r in to_last_branch(closed, branches, "u").collect()} == {(1, None), (2, None), (3, "y")}


def test_current_writes_go_on_where_they_stopped(spark, tmp_path):
    """State in the checkpoint: a second call reads only new files, late and repeated writes change nothing."""
    from factweave.streaming.watch import keep_current

    kinds = "target_type string, target_value string, key string, op string, value string, ts long, seq long"
    put = lambda *ks: spark.createDataFrame([("commit", "abc", k, "set", v, ts, ts) for k, v, ts in ks], kinds).write.mode("append").parquet(f"{tmp_path}/in")
    now = lambda: {r["key"]: r["value"] for r in keep_current(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/t").collect()}
    put(*((f"k{i}", "old", 1) for i in range(40)))
    assert now() == {f"k{i}": "old" for i in range(40)}
    put(("k3", "new", 5), ("k4", "late", 0), ("k5", "old", 1))
    assert now() == {f"k{i}": "new" if i == 3 else "old" for i in range(40)} == now()


def test_total_order(spark):
    from factweave.operators.ordering import numbered, with_previous

    df = spark.createDataFrame([(i * 7919 % 101, str(i)) for i in range(101)], "n long, v string").repartition(5)
    assert {r["n"]: r["place"] for r in numbered(df, [F.col("n")]).collect()} == {n: n + 1 for n in range(101)}
    name = {i * 7919 % 101: str(i) for i in range(101)}
    assert {r["n"]: r["previous"] for r in with_previous(df, "v", [F.col("n")]).collect()} == {n: name.get(n - 1) for n in range(101)}
    assert numbered(df.where("false"), [F.col("n")]).isEmpty()


def test_prefixes_of_any_number_and_length(spark):
    facts = spark.createDataFrame([("path", v) for v in ("a", "ab", "abc", "b", "ab")] + [("commit", "abcd")], "target_type string, target_value string")
    asked = spark.createDataFrame([("path", "a"), ("path", "abc"), ("path", "zz"), ("path", ""), ("commit", "ab"), ("path", "ab")], "kind string, prefix string")
    got = {(r["kind"], r["prefix"], r["target_value"], r["matches"]) for r in P.expand_targets(facts, asked).collect()}
    assert got == {("path", "a", "a", 2), ("path", "a", "ab", 2), ("path", "abc", "abc", 1), ("path", "", "a", 2), ("path", "", "ab", 2), ("commit", "ab", "abcd", 1), ("path", "ab", "ab", 2), ("path", "ab", "abc", 2)}
