"""Column functions over targets, keys, paths, values and messages. All built from Spark's own
functions: nothing here leaves the JVM. A null input gives null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of targets, in the stored spelling.
TARGET_TYPES = ("commit", "change-id", "branch", "path", "project")
DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_target(text: Column | str) -> Column:
    """struct<type, value, error> of ``type:value``; only the first colon parts, project has no value."""
    s = _col(text)
    has = F.instr(s, ":") > 0
    kind = F.when(s == "project", s).when(has, F.substring_index(s, ":", 1))
    value = F.when(has, F.substring(s, F.instr(s, ":") + 1, F.length(s)))
    error = (
        F.when(s == "project", F.lit(None).cast("string")).when(~has, F.lit("format"))
        .when(~kind.isin(*TARGET_TYPES), F.lit("type")).when((kind != "project") & (F.octet_length(value) < 3), F.lit("short"))
    )
    ok = error.isNull()
    return F.struct(F.when(ok, kind).alias("type"), F.when(ok & (kind != "project"), value).alias("value"), error.alias("error"))


def key_error(key: Column | str) -> Column:
    """Why a key can't be stored, else null: empty, dots, slash, nul or reserved segments."""
    k = _col(key)
    segments = F.split(k, ":")
    any_of = lambda test: F.exists(segments, test)
    return (
        F.when(any_of(lambda s: s == ""), F.lit("empty")).when(any_of(lambda s: (s == ".") | (s == "..")), F.lit("dots"))
        .when(F.contains(k, F.lit("/")), F.lit("slash")).when(F.contains(k, F.lit("\0")), F.lit("nul"))
        .when(any_of(lambda s: F.startswith(s, F.lit("__"))), F.lit("reserved"))
    )


def target_label(kind: Column | str, value: Column | str) -> Column:
    return F.when(_col(kind) == "project", F.lit("project")).otherwise(F.concat(_col(kind), F.lit(":"), _col(value)))


def shard(value: Column) -> Column:
    return F.substring(F.sha1(value), 1, 2)


def escape_path(value: Column | str) -> Column:
    """A tilde before each segment that starts with a tilde or two underscores."""
    return F.array_join(F.transform(F.split(_col(value), "/"), lambda s: F.when(s.rlike("^(~|__)"), F.concat(F.lit("~"), s)).otherwise(s)), "/")


def unescape_path(value: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(value), "/"), lambda s: F.regexp_replace(s, "^~", "")), "/")


def base_path(kind: Column | str, value: Column | str) -> Column:
    """Folder of a target: commits by their first two characters, branches and change ids by a hash."""
    t, v = _col(kind), _col(value)
    return (
        F.when(t == "project", F.lit("project")).when(t == "commit", F.concat_ws("/", t, F.substring(v, 1, 2), v))
        .when(t == "path", F.concat_ws("/", t, escape_path(v), F.lit("__target__"))).otherwise(F.concat_ws("/", t, shard(v), v))
    )


def fact_path(what: str, kind: Column | str, value: Column | str, key: Column | str, entry: Column | str | None = None) -> Column:
    """Path of a fact's file. ``what``: value, list, set, tombstone, list_tombstone or set_tombstone."""
    base, segments = base_path(kind, value), F.translate(_col(key), ":", "/")
    tail = {
        "value": ("__value",), "list": ("__list", entry), "set": ("__set", entry), "list_tombstone": ("__list", "__tombstones", entry), "set_tombstone": ("__tombstones", entry),
    }
    if what == "tombstone":
        return F.concat_ws("/", base, F.lit("__tombstones"), segments, F.lit("__deleted"))
    parts = [F.lit(p) if isinstance(p, str) and p.startswith("__") else _col(p) for p in tail[what] if p is not None]
    return F.concat_ws("/", base, segments, *parts)


def parse_path(path: Column | str) -> Column:
    """struct<type, value, parts>: target and key part of a path; null where it has no valid form.
    Of branches and change ids, whose values may hold slashes, the shortest value that fits the
    hash folder is taken."""
    p = F.split(_col(path), "/")
    kind, n = p[0], F.size(p)
    mark = F.array_position(p, "__target__").cast("int")
    special = F.transform(p, lambda s, i: F.when((i >= 3) & s.isin("__value", "__list", "__set", "__tombstones"), i))
    limit = F.coalesce(F.array_min(F.filter(special, lambda i: i.isNotNull())), n)
    ends = F.filter(F.sequence(F.lit(3), F.greatest(limit, F.lit(3))), lambda e: shard(F.array_join(F.slice(p, 3, e - 2), "/")) == p[1])
    end = F.when(kind == "commit", F.lit(3)).otherwise(F.coalesce(F.get(ends, F.lit(0)), F.lit(3)))
    sharded = F.struct(kind.alias("type"), F.array_join(F.slice(p, 3, end - 2), "/").alias("value"), F.slice(p, end + 1, F.greatest(n - end, F.lit(0))).alias("parts"))
    of_path = F.struct(kind.alias("type"), unescape_path(F.array_join(F.slice(p, 2, F.greatest(mark - 2, F.lit(1))), "/")).alias("value"), F.slice(p, mark + 1, F.greatest(n - mark, F.lit(0))).alias("parts"))
    whole = F.struct(kind.alias("type"), F.lit("").alias("value"), F.slice(p, 2, F.greatest(n - 1, F.lit(0))).alias("parts"))
    return (
        F.when(kind == "project", whole).when((kind == "path") & (mark >= 3) & (mark < n), of_path)
        .when(kind.isin("commit", "branch", "change-id") & (n >= 4), sharded)
    )


def entry_name(ts: Column | str, value: Column | str) -> Column:
    return F.concat(_col(ts).cast("string"), F.lit("-"), F.substring(F.sha1(_col(value)), 1, 5))


def is_entry_name(name: Column | str) -> Column:
    return _col(name).rlike("^[0-9]+-[0-9a-fA-F]{5}$")


def entry_ts(name: Column | str) -> Column:
    return F.when(is_entry_name(name), F.substring_index(_col(name), "-", 1).try_cast("long"))


def member_id(value: Column | str) -> Column:
    """SHA-1 of a blob's header and bytes."""
    v = _col(value)
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(v).cast("string")), "UTF-8"), F.lit(b"\0"), F.encode(v, "UTF-8")))


def pattern_regex(pattern: Column | str) -> Column:
    """Regular expression for a key followed by a colon: ``*`` is one segment, ``**`` any number."""
    each = lambda s: F.when(s == "**", F.lit("(?:[^:]*:)*")).when(s == "*", F.lit("[^:]*:")).otherwise(F.concat(F.lit("\\Q"), s, F.lit("\\E:")))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(_col(pattern), ":"), each), ""), F.lit("$"))


def parse_rule(rule: Column | str) -> Column:
    """struct<action, pattern, dests, error> of ``exclude P`` or ``route P d1,d2``."""
    parts = F.split(F.trim(F.regexp_replace(_col(rule), "\\s+", " ")), " ")
    action, n = parts[0], F.size(parts)
    dests = F.filter(F.split(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), ","), lambda d: d != "")
    error = (
        F.when(n < 2, F.lit("incomplete")).when(~action.isin("exclude", "route"), F.lit("action"))
        .when((action == "route") & (n < 3), F.lit("destination"))
    )
    return F.struct(
        F.when(error.isNull(), action).alias("action"), F.when(error.isNull(), F.get(parts, F.lit(1))).alias("pattern"),
        F.when(error.isNull() & (action == "route"), dests).otherwise(F.array().cast("array<string>")).alias("dests"), error.alias("error"),
    )


def cutoff_ms(since: Column | str, now_ms: int) -> Column:
    """Start of a retention window: ``90d``, ``6m`` (of 30 days), ``1y`` (of 365), or a date at UTC midnight."""
    s = F.lower(F.trim(_col(since)))
    count = F.regexp_extract(s, "^([0-9]+)[dmy]$", 1)
    days = count.try_cast("long") * F.when(s.endswith("d"), 1).when(s.endswith("m"), 30).otherwise(365)
    date = F.datediff(F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s).try_cast("date"), F.lit("1970-01-01").cast("date"))
    return F.when(count != "", F.lit(now_ms) - days * DAY_MS).otherwise(date.cast("long") * DAY_MS)


def size_bytes(text: Column | str) -> Column:
    """Bytes of ``512k``, ``10M``, ``1g``; null for anything else."""
    s = F.lower(F.trim(_col(text)))
    n = F.regexp_extract(s, "^([0-9]+)([kmg]?)$", 1).try_cast("long")
    unit = F.regexp_extract(s, "^([0-9]+)([kmg]?)$", 2)
    return n * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def key_shape(key: Column | str) -> Column:
    return F.regexp_replace(_col(key), "[0-9]+", "[n]")


def preview(value: Column | str, width: int = 50) -> Column:
    """The first line, cut at ``width`` characters, with a sign that more follows; arrays and objects
    by their sizes."""
    v = _col(value)
    first = F.substring_index(v, "\n", 1)
    items, fields = F.json_array_length(v), F.size(F.json_object_keys(v))
    more = F.contains(v, F.lit("\n")) & (F.regexp_replace(v, "\n+$", "") != first)
    plain = F.when(F.length(first) > width, F.concat(F.substring(first, 1, width), F.lit("..."))).when(more, F.concat(first, F.lit(" ..."))).otherwise(first)
    return (
        F.when(F.substring(F.ltrim(v), 1, 1).eqNullSafe("[") & items.isNotNull(), F.format_string("[list: %d items]", items))
        .when(F.substring(F.ltrim(v), 1, 1).eqNullSafe("{") & F.json_object_keys(v).isNotNull(), F.format_string("{object: %d keys}", fields)).otherwise(plain)
    )


def truncate(value: Column | str, width: int = 50) -> Column:
    v = _col(value)
    return F.when(F.length(v) <= width, v).otherwise(F.concat(F.substring(v, 1, width - 3), F.lit("...")))


def render_compact(value_type: Column | str, values: Column) -> Column:
    """Values of a list in order, members of a set sorted, joined by comma and space."""
    return F.array_join(F.when(_col(value_type) == "set", F.sort_array(values)).otherwise(values), ", ")


def sanitise(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[/:\\x00]", "-")


def branch_id(head: Column | str, number: Column | str) -> Column:
    return F.concat(sanitise(head), F.lit("#"), _col(number).cast("string"))


def strip(text: Column | str) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def conventional_type(subject: Column | str) -> Column:
    """struct<type, breaking> of ``type(scope)!: text``; both null for other subjects. White space
    around the head and around the type doesn't count, a space within the head rules it out."""
    s = _col(subject)
    head = strip(F.when(F.contains(s, F.lit(":")), F.substring_index(s, ":", 1)))
    breaking = head.endswith("!")
    name = strip(F.substring_index(F.regexp_replace(head, "!$", ""), "(", 1))
    ok = head.isNotNull() & ~F.contains(head, F.lit(" ")) & name.rlike("^[a-z0-9-]+$")
    return F.struct(F.when(ok, name).alias("type"), F.when(ok, breaking).alias("breaking"))


#: Words that close an issue.
CLOSERS = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")


def closing_issues(body: Column | str) -> Column:
    """Issues (``#12``) that follow a closing keyword, distinct and in the order of their texts."""
    words = F.split(F.trim(F.regexp_replace(_col(body), "\\s+", " ")), " ")
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    hits = F.filter(pairs, lambda p: F.lower(F.regexp_replace(p["a"], "^[^A-Za-z]+|[^A-Za-z]+$", "")).isin(*CLOSERS) & p["b"].rlike("^[.,()]*#[0-9]+[.,()]*$"))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda p: F.regexp_extract(p["b"], "#[0-9]+", 0))))


def trailers(message: Column | str, name: str) -> Column:
    """All values of ``Name: value`` lines, in order."""
    return F.regexp_extract_all(_col(message), F.lit(f"(?m)^[ \\t]*{name}:[ \\t]*(\\S.*?)[ \\t]*$"), F.lit(1))


def last_trailer(message: Column | str, name: str) -> Column:
    return F.try_element_at(trailers(message, name), F.lit(-1))


def email_of(author: Column | str) -> Column:
    """The address in ``Name <address>``, or the text itself."""
    a = _col(author)
    found = F.regexp_extract(a, "<([^>]*)>", 1)
    return F.when(found != "", found).otherwise(a)


def date_range(low: Column, high: Column) -> Column:
    """``day`` or ``day..day`` of two epoch seconds, in UTC."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")).cast("string")
    return F.when(day(low) == day(high), day(low)).otherwise(F.concat(day(low), F.lit(".."), day(high)))


def content_texts(content: Column | str) -> Column:
    """Texts of a message: itself, or those of its blocks of type text; trimmed, none empty."""
    c = _col(content)
    blocks = F.from_json(c, "array<struct<type:string,text:string>>")
    texts = F.when(F.ltrim(c).startswith("["), F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.trim(b["text"]))).otherwise(F.array(F.trim(c)))
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def author_identity(login: Column | str, name: Column | str) -> Column:
    """The login where there is one, else the name, as it stands; null if that is blank."""
    who = F.coalesce(_col(login), _col(name))
    return F.when(strip(who) != "", who)


def rfc3339_ms(text: Column | str) -> Column:
    """Milliseconds since 1970 of a UTC time stamp, whole seconds."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(_col(text), "Z$", "+00:00"))) * 1000


def age_label(ts: Column | str, now: int) -> Column:
    """``5m ago`` and the like, from epoch seconds."""
    d = F.lit(now) - _col(ts)
    whole = lambda n: F.floor(d / n).cast("string")
    return (
        F.when(d < 0, F.lit("in the future")).when(d < 60, F.concat(d.cast("string"), F.lit("s ago"))).when(d < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(d < 86400, F.concat(whole(3600), F.lit("h ago"))).when(d < 7 * 86400, F.concat(whole(86400), F.lit("d ago")))
        .when(F.floor(d / (7 * 86400)) < 5, F.concat(whole(7 * 86400), F.lit("w ago"))).when(F.floor(d / (30 * 86400)) < 12, F.concat(whole(30 * 86400), F.lit("mo ago")))
        .otherwise(F.concat(whole(365 * 86400), F.lit("y ago")))
    )


def tool_summary(input_json: Column | str) -> Column:
    """First of command, file path, pattern, or the start of the prompt."""
    j = _col(input_json)
    get = lambda p: F.get_json_object(j, f"$.{p}")
    return F.coalesce(get("command"), get("file_path"), get("pattern"), F.substring(get("prompt"), 1, 120))


def json_encode(value: Column | str) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(_col(value).alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)


def decode_list(payload: Column | str) -> Column:
    """array<struct<ts, value>> of a stored list: objects with value and timestamp, or bare strings,
    whose timestamp is their index."""
    items = F.from_json(_col(payload), "array<string>")

    def one(item: Column, i: Column) -> Column:
        boxed = F.ltrim(item).startswith("{")
        return F.struct(
            F.when(boxed, F.get_json_object(item, "$.timestamp").try_cast("long")).otherwise(i.cast("long")).alias("ts"),
            F.when(boxed, F.get_json_object(item, "$.value")).otherwise(item).alias("value"),
        )

    return F.transform(items, one)
