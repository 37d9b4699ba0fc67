"""Current facts from the mutation log.

``mutations`` rows: seq, target_type, target_value, key (together K), op (set, rm, push, pop,
list_rm, set_add, set_rm), value, value_type, idx, email, ts. Within a key, order is by seq.

Each fold is an aggregation over K, or a running one that is split over tasks within a key. Keys whose
outcome hangs on the order of unlike operations (``list_rm``, pushes after pops, several types) go through one sequential fold per key;
all other keys stay in built-in functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import scalars
from factweave.operators.ordering import increasing, scan, spread
from factweave.operators.shared import stored

K = ["target_type", "target_value", "key"]
LEGACY = {"list:push": "push", "list:pop": "pop", "list:rm": "list_rm", "set:add": "set_add", "set:rm": "set_rm"}


@dataclass
class State:
    """values: K, value, last_ts; entries: K, value, ts; members: K, value, ts;
    tombstones: K, ts, email; member_tombstones: K, value, ts, email."""

    values: DataFrame
    entries: DataFrame
    members: DataFrame
    tombstones: DataFrame
    member_tombstones: DataFrame


def normalise_ops(mutations: DataFrame) -> DataFrame:
    """Legacy spellings of operations become the present ones."""
    old = F.create_map(*(F.lit(x) for pair in LEGACY.items() for x in pair))
    return mutations.withColumn("op", F.coalesce(F.try_element_at(old, F.col("op")), F.col("op")))


def last_per_key(mutations: DataFrame, *more: str) -> DataFrame:
    """The newest row of each K (and further columns), by (ts, seq)."""
    rest = [c for c in mutations.columns if c not in (*K, *more)]
    return mutations.groupBy(*K, *more).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("l")).select(*K, *more, "l.*")


def last_op(mutations: DataFrame) -> DataFrame:
    """K, value, op: the last operation of every key and member."""
    return mutations.groupBy(*K, "value").agg(F.max_by("op", "seq").alias("op"))


def state_from_log(log: DataFrame) -> DataFrame:
    """K, op, value, last_ts straight from a log whose rows carry whole values."""
    return last_per_key(log).select(*K, "op", "value", F.col("ts").alias("last_ts"))


def fold_strings(mutations: DataFrame) -> DataFrame:
    """K, value, last_ts, email of string keys whose last write isn't undone."""
    own = mutations.where("op in ('set', 'rm') and value_type = 'string'")
    last = own.groupBy(*K).agg(F.max_by(F.struct("op", "value", "ts", "email"), "seq").alias("l"))
    return last.where("l.op = 'set'").select(*K, "l.value", F.col("l.ts").alias("last_ts"), "l.email")


def _first_after(removals: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, email of the first removal after each key's last write. The last writes are folded
    first, so that only removals after them meet, and these reduce in their tasks."""
    last = writes.groupBy(*keys).agg(F.max("seq").alias("w"))
    late = removals.select(*keys, "seq", "ts", "email").join(last, keys).where("seq > w")
    return late.groupBy(*keys).agg(F.min_by(F.struct("ts", "email"), "seq").alias("t")).select(*keys, "t.ts", "t.email")


def fold_remove(mutations: DataFrame) -> DataFrame:
    """K, ts, email: tombstones of removed keys. Only the first removal after a write counts; one of
    an absent key leaves nothing."""
    return _first_after(mutations.where("op = 'rm'"), mutations.where("op in ('set', 'push', 'set_add')"), K)


def bumped(rows: DataFrame, order: list[Column], keys: list[str] = K) -> DataFrame:
    """ts made strictly increasing along ``order``; a key of any number of rows is spread over tasks."""
    return increasing(rows, keys, order, "ts")


def fold_list_push(mutations: DataFrame) -> DataFrame:
    """K, value, ts: list entries of keys that see pushes only. A string set before the first push is
    an entry with ts 0."""
    pushes, sets = mutations.where("op = 'push'"), mutations.where("op = 'set' and value_type = 'string'")
    first = pushes.groupBy(*K).agg(F.min("seq").alias("first"))
    seeds = sets.join(first, K).where("seq < first").groupBy(*K).agg(F.max_by(F.struct("seq", "value"), "seq").alias("s"))
    seeds = seeds.select(*K, "s.seq", "s.value", F.lit(0).cast("long").alias("ts"))
    rows = pushes.select(*K, "seq", "value", F.col("ts").cast("long").alias("ts")).unionByName(seeds)
    return bumped(rows, [F.col("seq")]).select(*K, "value", "ts")


def fold_list_set(mutations: DataFrame) -> DataFrame:
    """K, value, ts after whole-list writes: the last one replaces all entries, later pushes follow."""
    own = mutations.where("value_type = 'list' and op in ('set', 'push')")
    cut = own.where("op = 'set'").groupBy(*K).agg(F.max("seq").alias("cut"))
    own = own.join(cut, K, "left").where("cut is null or seq >= cut")
    items = F.when(F.col("op") == "set", scalars.decode_list("value")).otherwise(F.array(F.struct("ts", "value")))
    rows = own.select(*K, "seq", F.posexplode(items).alias("pos", "i")).select(*K, "seq", "pos", "i.ts", "i.value")
    return bumped(rows, [F.col("seq"), F.col("pos")]).select(*K, "value", "ts")


def fold_set_set(mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, tombstones) after whole-set writes: kept members keep the ts of the write from which
    on they were always there, dropped ones leave a tombstone with the ts of the write that dropped them."""
    writes = mutations.where("op = 'set' and value_type = 'set'").withColumn("n", F.row_number().over(W.partitionBy(*K).orderBy("seq")))
    at = writes.withColumn("members", F.array_distinct(F.from_json("value", "array<string>")))
    last = at.groupBy(*K).agg(F.max("n").alias("last"))
    rows = at.select(*K, "n", "ts", "email", F.explode("members").alias("value"))
    island = F.col("n") - F.row_number().over(W.partitionBy(*K, "value").orderBy("n"))
    runs = rows.withColumn("island", island).groupBy(*K, "value", "island").agg(F.min("ts").alias("since"), F.max("n").alias("n"))
    end = runs.groupBy(*K, "value").agg(F.max_by(F.struct("since", "n"), "n").alias("r")).select(*K, "value", "r.since", "r.n").join(last, K)
    dropped = end.where("n < last").join(at.select(*K, (F.col("n") - 1).alias("n"), "ts", "email"), [*K, "n"])
    return end.where("n = last").select(*K, "value", F.col("since").alias("ts")), dropped.select(*K, "value", "ts", "email")


def fold_set(mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, tombstones) of keys that see set_add and set_rm: the last operation of each member
    counts; removing an absent member leaves nothing."""
    member = [*K, "value"]
    own = mutations.where("op in ('set_add', 'set_rm')")
    last = own.groupBy(*member).agg(F.max_by(F.struct("op", "ts"), "seq").alias("l"))
    live = last.where("l.op = 'set_add'").select(*member, "l.ts")
    return live, _first_after(own.where("op = 'set_rm'"), own.where("op = 'set_add'"), member)


def fold_list_pop(mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of keys that see pushes and pops, none of a pop before a push: a pop takes
    the last equal entry, found as matching brackets by the running balance of each value."""
    own = mutations.where("op in ('push', 'pop')")
    pushed = bumped(own.where("op = 'push'"), [F.col("seq")])
    by, order = [*K, "value"], [F.col("seq")]
    rows = spread(pushed.unionByName(own.where("op = 'pop'")).select(*by, "seq", "op", "ts"), by, order)
    rows = scan(rows, by, order, F.when(F.col("op") == "push", 1).otherwise(-1), "s", "sum")
    rows = scan(rows, by, order, F.col("s"), "lowest", "min", before=True)
    # a pop that finds nothing sets a new low below nought; heights above the low match like brackets
    rows = rows.withColumn("before", F.least(F.lit(0), "lowest")).withColumn("low", F.least("before", "s")).withColumn("height", F.col("s") - F.col("low"))
    rows = scan(rows, by, order, F.col("height"), "later", "min", before=True, backward=True)
    entries = rows.where("op = 'push' and coalesce(later, height) >= height").select(*K, "value", "ts")
    missed = rows.where("op = 'pop' and low < before").select("seq", *K)
    return entries, _missing(missed, own.where("op = 'push'"))


def _missing(missed: DataFrame, writes: DataFrame) -> DataFrame:
    """seq, K, reason of removals that found nothing: KeyNotFound before the key's first write, which
    makes it exist for good, ValueNotFound after it."""
    first = writes.groupBy(*K).agg(F.min("seq").alias("first"))
    reason = F.when(F.col("first") < F.col("seq"), "ValueNotFound").otherwise("KeyNotFound")
    return missed.select("seq", *K).join(first, K, "left").select("seq", *K, reason.alias("reason"))


def apply_tombstones(values: DataFrame, members: DataFrame, known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, members, tombstones) after foreign whole-key tombstones, which remove unconditionally."""
    dead = new.select(*K).distinct()
    both = known.select(*K, "ts", "email", F.lit(0).alias("p")).unionByName(new.select(*K, "ts", "email", F.lit(1).alias("p")))
    tombs = both.groupBy(*K).agg(F.max_by(F.struct("ts", "email"), F.struct("p", "ts")).alias("t")).select(*K, "t.ts", "t.email")
    return values.join(dead, K, "left_anti"), members.join(dead, K, "left_anti"), tombs


def add_promised(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys known from history become promised rows where they are absent."""
    new = keys.select(*K).distinct().join(values.select(*K), K, "left_anti")
    return values.select(*K, "value", "last_ts", "is_promised").unionByName(new.select(*K, F.lit("").alias("value"), F.lit(0).cast("long").alias("last_ts"), F.lit(True).alias("is_promised")))


def resolve_promised(values: DataFrame, found: DataFrame) -> DataFrame:
    """Promised rows take the found values; those without one are dropped."""
    f = found.select(*K, F.col("value").alias("f"), F.col("last_ts").alias("fts"))
    rows = values.join(f, K, "left").where("not is_promised or f is not null")
    fill = F.col("is_promised") & F.col("f").isNotNull()
    return rows.select(*K, F.when(fill, F.col("f")).otherwise(F.col("value")).alias("value"), F.when(fill, F.col("fts")).otherwise(F.col("last_ts")).alias("last_ts"))


def invalid_rows(mutations: DataFrame) -> DataFrame:
    """seq and reason of rows that no state can take: InvalidTarget, InvalidKey, InvalidValue."""
    bad_target = ~F.col("target_type").isin(*scalars.TARGET_TYPES) | (F.col("target_type") != "project") & (F.octet_length("target_value") < 3)
    reason = (
        F.when(bad_target, "InvalidTarget").when(scalars.key_error("key").isNotNull(), "InvalidKey")
        .when(F.col("value").isNull() & ~F.col("op").isin("rm", "list_rm"), "InvalidValue")
    )
    return mutations.withColumn("reason", reason).where("reason is not null").select("seq", "reason")


def absent_removals(mutations: DataFrame) -> DataFrame:
    """seq, K and reason of set_rm of an absent member (its last operation before isn't set_add):
    KeyNotFound where the key has no member yet, else ValueNotFound."""
    own = mutations.where("op in ('set_add', 'set_rm')")
    before = F.lag("op").over(W.partitionBy(*K, "value").orderBy("seq"))
    return _missing(own.withColumn("before", before).where("op = 'set_rm' and not before <=> 'set_add'"), own.where("op = 'set_add'"))


def ordered_keys(mutations: DataFrame) -> DataFrame:
    """Keys whose outcome hangs on the order of unlike operations."""
    kinds = F.when(F.col("op").isin("push", "pop", "list_rm"), "list").when(F.col("op").isin("set_add", "set_rm"), "set").when(F.col("op") == "set", F.col("value_type"))
    sums = mutations.groupBy(*K).agg(
        F.count_distinct(kinds).alias("kinds"), F.bool_or(F.col("op") == "list_rm").alias("rm"), F.bool_or(F.col("op") == "rm").alias("cut"),
        F.min(F.when(F.col("op") == "pop", F.col("seq"))).alias("pop"), F.max(F.when(F.col("op") == "push", F.col("seq"))).alias("push"),
        F.bool_or((F.col("op") == "set") & (F.col("value_type") != "string")).alias("whole"), F.bool_or(kinds != "string").alias("many"),
    )
    odd = (F.col("kinds") > 1) | F.col("rm") | (F.col("pop") < F.col("push")) | (F.coalesce("many", F.lit(False)) & (F.col("cut") | F.coalesce("whole", F.lit(False))))
    return sums.where(F.coalesce(odd, F.lit(False))).select(*K)


FOLDED = "target_type string, target_value string, key string, part string, value string, ts long, email string, seq long"


class Entries:
    """A list of (value, ts) whose n-th entry and last entry of a value are found and removed in a number of
    steps that goes by the logarithm of its length. Removed slots stay until they are most of it; a tree of
    counts (each of the slots that its number's lowest bit spans) tells how many before a slot are left."""

    def __init__(self):
        self.slots, self.counts, self.places, self.left = [], [0], {}, 0

    def __len__(self) -> int:
        return self.left

    def __iter__(self):
        return (e for e in self.slots if e is not None)

    def append(self, value: str, ts: int) -> None:
        self.slots.append((value, ts))
        self.places.setdefault(value, []).append(len(self.slots))
        self.left += 1
        n = len(self.slots)
        total, below, end = 1, n - 1, n - (n & -n)
        while below > end:
            total += self.counts[below]
            below -= below & -below
        self.counts.append(total)

    def last_ts(self) -> int | None:
        while self.slots and self.slots[-1] is None:  # a slot at the end is in no other slot's count
            self.slots.pop()
            self.counts.pop()
        return self.slots[-1][1] if self.slots else None

    def _remove(self, n: int) -> tuple[str, int]:
        entry, self.slots[n - 1] = self.slots[n - 1], None
        self.left -= 1
        at = n
        while at < len(self.counts):
            self.counts[at] -= 1
            at += at & -at
        if len(self.slots) > 64 and self.left * 4 < len(self.slots):
            rest = list(self)
            self.slots, self.counts, self.places, self.left = [], [0], {}, 0
            for e in rest:
                self.append(*e)
        return entry

    def pop_value(self, value: str) -> bool:
        """Removes the last entry of this value, if there is one."""
        places = self.places.get(value, [])
        while places:
            n = places.pop()
            if n <= len(self.slots) and self.slots[n - 1] is not None and self.slots[n - 1][0] == value:  # else it went by its number
                self._remove(n)
                return True
        return False

    def pop_at(self, nth: int) -> str:
        """Removes the n-th entry, from 0, and returns its value."""
        at, step, rest = 0, 1 << (len(self.counts) - 1).bit_length(), nth + 1
        while step:
            if at + step < len(self.counts) and self.counts[at + step] < rest:
                at += step
                rest -= self.counts[at]
            step >>= 1
        return self._remove(at + 1)[0]


class Fold:
    """The state of one key while its operations go by, one after another."""

    def __init__(self, k: tuple):
        self.k = k
        self.kind, self.text, self.entries, self.members, self.tombs, self.key_tomb = None, None, Entries(), {}, {}, None
        self.entry_tombs: list[tuple] = []
        self.rejects: list[tuple] = []

    def _later(self, ts: int) -> int:
        last = self.entries.last_ts()
        return ts if last is None or ts > last else last + 1

    def _set(self, r) -> None:
        old = self.members if r.value_type == "set" else {}
        self.entries, self.members, self.key_tomb = Entries(), {}, None
        if r.value_type == "string":
            self.kind, self.text, self.tombs = "string", (r.value, r.ts), {}
        elif r.value_type == "list":
            self.kind = "list"
            for i, item in enumerate(json.loads(r.value)):
                v, ts = (item["value"], int(item["timestamp"])) if isinstance(item, dict) else (item, i)
                self.entries.append(v, self._later(ts))
        else:
            self.kind, new = "set", dict.fromkeys(json.loads(r.value))
            self.tombs |= {m: (r.ts, r.email) for m in old if m not in new}
            self.members = {m: old.get(m, r.ts) for m in new}
            self.tombs = {m: t for m, t in self.tombs.items() if m not in new}

    def _push(self, r) -> str | None:
        if self.kind == "set":
            return "TypeMismatch"
        if self.kind == "string":
            self.entries = Entries()
            self.entries.append(self.text[0], 0)
        self.kind, self.key_tomb = "list", None
        self.entries.append(r.value, self._later(r.ts))
        return None

    def _shorten(self, r) -> str | None:
        if self.kind != "list":
            return "KeyNotFound" if self.kind is None else "TypeMismatch"
        if r.op == "pop":
            return None if self.entries.pop_value(r.value) else "ValueNotFound"
        if pd.isna(r.idx) or not 0 <= int(r.idx) < len(self.entries):
            return "IndexOutOfRange"
        self.entry_tombs.append((self.entries.pop_at(int(r.idx)), r.ts, r.email))
        return None

    def _member(self, r) -> str | None:
        if self.kind not in (None, "set"):
            return "TypeMismatch"
        if r.op == "set_add":
            self.kind, self.key_tomb = "set", None
            self.members[r.value] = r.ts
            self.tombs.pop(r.value, None)
            return None
        if self.kind is None:
            return "KeyNotFound"
        if r.value not in self.members:
            return "ValueNotFound"
        del self.members[r.value]
        self.tombs[r.value] = (r.ts, r.email)
        return None

    def apply(self, r) -> None:
        reason = None
        if r.op == "set":
            self._set(r)
        elif r.op == "push":
            reason = self._push(r)
        elif r.op in ("pop", "list_rm"):
            reason = self._shorten(r)
        elif r.op in ("set_add", "set_rm"):
            reason = self._member(r)
        elif r.op == "rm" and self.kind is not None:
            self.kind, self.text, self.entries, self.members, self.entry_tombs, self.key_tomb = None, None, Entries(), {}, [], (r.ts, r.email)
        if reason:
            self.rejects.append((*self.k, "reject", reason, None, None, r.seq))

    def rejected(self) -> list[tuple]:
        """Rows of the rejects since the last call."""
        out, self.rejects = self.rejects, []
        return out

    def rows(self) -> list[tuple]:
        k = self.k
        out = [(*k, "value", self.text[0], self.text[1], None, None)] if self.kind == "string" else []
        out += [(*k, "entry", v, ts, None, i) for i, (v, ts) in enumerate(self.entries)] if self.kind == "list" else []
        out += [(*k, "member", m, ts, None, None) for m, ts in self.members.items()] if self.kind == "set" else []
        out += [(*k, "tombstone", None, *self.key_tomb, None)] if self.key_tomb else []
        out += [(*k, "member_tombstone", m, *t, None) for m, t in self.tombs.items()]
        return out + [(*k, "entry_tombstone", v, ts, e, None) for v, ts, e in self.entry_tombs]


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys one after another, each one's operations in order; a key may span batches."""
    names = [c.split()[0] for c in FOLDED.split(", ")]
    frame = lambda out: pd.DataFrame(out, columns=names).astype({"ts": "Int64", "seq": "Int64"})
    fold: Fold | None = None
    for batch in batches:
        out: list[tuple] = []
        for r in batch.itertuples(index=False):
            k = (r.target_type, r.target_value, r.key)
            if fold is None or fold.k != k:
                out += [*fold.rejected(), *fold.rows()] if fold else []
                fold = Fold(k)
            fold.apply(r)
        out += fold.rejected() if fold else []
        yield frame(out)
    if fold:
        yield frame(fold.rows())


def fold_in_order(mutations: DataFrame) -> DataFrame:
    """FOLDED rows of keys that need a sequential fold. Operations stream through a task in order; it
    holds one key's present state and a batch, not a key's log."""
    rows = mutations.select("seq", *K, "op", "value", "value_type", "idx", "email", "ts")
    n = int(mutations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *K).sortWithinPartitions(*K, "seq").mapInPandas(_fold_sorted, FOLDED)


def replay(mutations: DataFrame) -> DataFrame:
    """K, part (value, entry, member, tombstone, member_tombstone, entry_tombstone, reject), value,
    ts, email, seq after all operations. One aggregate finds the keys that need the sequential fold;
    rows are stored with that mark, and each fold reads the operations that it needs."""
    m = normalise_ops(mutations)
    odd = ordered_keys(m).withColumn("odd", F.lit(True))
    marked = stored(m.join(odd, K, "left").withColumn("odd", F.col("odd").isNotNull()), "marked", "odd")
    plain = marked.where("not odd").drop("odd")
    none = {"value": "string", "ts": "long", "email": "string", "seq": "long"}

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(*K, F.lit(name).alias("part"), *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    entries, no_value = fold_list_pop(plain)
    members, dropped = fold_set(plain)
    strings = fold_strings(plain).withColumnRenamed("last_ts", "ts").drop("email")
    out = part(strings, "value").unionByName(part(entries, "entry")).unionByName(part(members, "member")).unionByName(part(fold_remove(plain), "tombstone"))
    out = out.unionByName(part(dropped, "member_tombstone"))
    rejects = no_value.unionByName(absent_removals(plain)).withColumnRenamed("reason", "value")
    return out.unionByName(part(rejects, "reject")).unionByName(fold_in_order(marked.where("odd").drop("odd")))
