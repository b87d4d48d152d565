r"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class. DataFrame operations only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the contract. Letters of the key words are spelled in either case, so that every engine reads them alike.
KEYS = "|".join(_either(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run that is too short fails at each of its places, so a least length in the pattern drops the same runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Class: what its strings consist of, the letters that are counted, kinds of letters that a string must hold, bits of entropy at
#: which a window is a secret.
CLASSES = {
    "hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", ("[0-9]", "[A-Fa-f]"), 3.05),
    "lower": (r"[a-z0-9]{20,}", "abcdefghijklmnopqrstuvwxyz0123456789", ("[0-9]", "[g-z]"), 3.6),
    "upper": (r"[A-Z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ("[0-9]", "[G-Z]"), 3.6),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", ("[0-9]", "[A-Z]", "[a-z]"), 3.95),
}
#: Counters of a window lie in longs, this many in each, of five bits.
PACKED = 12
#: Code points of the pieces that a text is cut into before parts of it are taken.
PIECE = 4096
#: Strings that look random and aren't secrets: identifiers in the form of UUIDs, place holders, runs of one character.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    rf"{_either('example')}|{_either('sample')}|{_either('placeholder')}|[Xx]{{8,}}",
    r"^(.)\1*$",
)


def let(value: Column, then) -> Column:
    """then(value), value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, op) -> Column:
    """Running totals of an array of non-negative ints by op (sum or greatest), in time n * sqrt(n): by blocks, then over the blocks."""
    ints = F.expr("cast(array() as array<int>)")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    grow = lambda acc, x: F.concat(acc, F.array(op(last(acc), x)))

    def total(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: F.slice(v, i * size + 1, size))
        inside = F.transform(blocks, lambda block: F.aggregate(block, ints, grow))
        carried = lambda rel: F.aggregate(rel, ints, lambda acc, r: grow(acc, last(r)))
        add = lambda rel: let(carried(rel), lambda tops: F.flatten(F.transform(rel, lambda r, i: F.transform(r, lambda x: op(F.coalesce(F.get(tops, i - 1), F.lit(0)), x)))))
        return let(inside, add)

    return let(values, lambda v: F.when(F.size(v) > 0, total(v)).otherwise(ints))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches from left to right: array of (start, end, value), in code points; value is the group's.

    Matches and what lies between them alternate, so running sums of their lengths are the places.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    steps = F.zip_with(F.split(text, pattern, -1), every(0), lambda g, m: F.when(m.isNull(), F.lit(0)).otherwise(F.length(g) + F.length(m)))
    ends = F.zip_with(running(steps, lambda a, b: a + b), every(0), lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    ends = F.filter(ends, lambda x: x["value"].isNotNull())
    if group:
        ends = F.zip_with(ends, every(group), lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), ends).otherwise(none)


def most_entropy(value: Column, letters: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of the string; letters are all that can occur in it.

    One pass over the codes of its letters: a window's counts follow from those before by the letter that enters and the one that
    leaves, and so does sum(c * log2(c)), from which the entropy is log2(window) - sum / window. Counts are packed into
    a few longs, so a step touches two of them.
    """
    weights = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 1)])
    weigh = lambda c: F.get(weights, c)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (k % PACKED))
    count = lambda counts, k: F.call_function("shiftright", F.get(counts, F.floor(k / PACKED).cast("int")), 5 * (k % PACKED)).bitwiseAND(F.lit(31)).cast("int")
    change = lambda counts, k, by: F.transform(counts, lambda c, j: F.when(j == F.floor(k / PACKED), c + by * one(k)).otherwise(c))
    state = lambda counts, s, least, at: F.struct(counts.alias("counts"), s.alias("s"), least.alias("least"), at.alias("at"))

    def steps(codes: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            gone = F.get(codes, acc["at"] - window)  # null while the first window fills
            less = F.when(gone.isNotNull(), count(acc["counts"], gone))
            left = F.when(gone.isNotNull(), change(acc["counts"], gone, -1)).otherwise(acc["counts"])
            s = acc["s"] + F.when(gone.isNotNull(), weigh(less - 1) - weigh(less)).otherwise(F.lit(0.0))

            def enter(left: Column) -> Column:
                more = count(left, k)
                now = s + weigh(more + 1) - weigh(more)
                return state(change(left, k, 1), now, F.when(acc["at"] >= window - 1, F.least(acc["least"], now)).otherwise(acc["least"]), acc["at"] + 1)

            return let(left, enter)

        start = state(F.array_repeat(F.lit(0).cast("long"), -(-len(letters) // PACKED)), F.lit(0.0), F.lit(window * 64.0), F.lit(0))
        return F.aggregate(codes, start, step, lambda acc: F.lit(log2(window)) - acc["least"] / window)

    codes = F.transform(F.slice(F.split(value, "", -1), 1, F.length(value)), lambda c: (F.position(c, F.lit(letters)) - 1).cast("int"))
    return let(codes, steps)


def untouched(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others; both are ascending and without overlaps among themselves.

    Sorted together, others by their start and spans by their last place, a span comes after as many of others as begin before its
    end; the last of these is the only one that has to be looked at.
    """
    a = F.transform(spans, lambda x, i: F.struct((x["end"] - 1).alias("at"), F.lit(1).alias("kind"), i.alias("i")))
    b = F.transform(others, lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("i")))
    ahead = lambda both: F.filter(F.transform(both, lambda x, j: F.when(x["kind"] == 1, j - x["i"])), lambda n: n.isNotNull())
    free = lambda n: F.filter(spans, lambda x, i: ~F.coalesce(F.get(others, F.get(n, i) - 1)["end"] > x["start"], F.lit(False)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(a, b)), lambda both: let(ahead(both), free))).otherwise(spans)


def suppressed(value: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    out = F.lit(False)
    for pattern in allow:
        out = out | value.rlike(pattern)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A name like name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scan(docs: DataFrame, text: str = "text", out: str = "found", window: int = WINDOW, classes: dict = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The rows of docs with a column out: array of (start, order, end) by start, then kind, order being the place in KINDS.

    Kinds assign, access and hex are the leftmost non-overlapping matches of each pattern, those that are too short dropped.
    Kind entropy: a maximal string of a class in which some window of 20 characters has at least the entropy of the class,
    unless the allow-list knows it or it overlaps a span of another kind; strings must hold the kinds of letters of their class.
    Places count code points, the end is exclusive. Null and empty texts have no spans; whole texts are scanned, in time that
    grows with their length (matches: n * sqrt(n)); repeated rows each give a row; an empty table gives none. Other columns stay
    as they are, whatever their names; a column named like out is refused.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out} already")
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    own, held = fresh(docs, "own"), fresh(docs, "held")
    body = F.coalesce(F.col(text), F.lit(""))
    base = [F.filter(found(body, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST), found(body, ACCESS), found(body, HEX)]
    rows = docs.withColumn(held, F.struct(*[c.alias(f"k{k}") for k, c in enumerate(base)]))
    some = []
    for pattern, _, kinds, _ in classes.values():
        sound = (lambda kinds: lambda x: _all([x["value"].rlike(k) for k in kinds]) & ~suppressed(x["value"], allow))(kinds)
        got = F.filter(found(body, pattern), sound)
        for k in range(len(base)):
            got = let(got, (lambda k: lambda g: untouched(g, F.col(held)[f"k{k}"]))(k))
        some.append(got)
    rows = rows.withColumn(own, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(some)]))
    hot = []
    for i, (_, letters, _, bits) in enumerate(classes.values()):
        hot.append(F.transform(F.filter(F.col(own)[f"c{i}"], (lambda letters, bits: lambda x: most_entropy(x["value"], letters, window) >= bits)(letters, bits)), span(3)))
    every = F.array_sort(F.concat(*[F.transform(F.col(held)[f"k{k}"], span(k)) for k in range(len(base))], *hot))
    once = let(every, lambda e: F.filter(e, lambda x, i: ~F.coalesce(F.get(e, i - 1) == x, F.lit(False))))
    return rows.withColumn(out, once).drop(own, held)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (ascending by start) replaced by a mark; spans that overlap give one mark."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def cut(held: Column) -> Column:
        piece = lambda at: F.floor(at / PIECE).cast("int")
        between = lambda a, b: F.substring(F.array_join(F.slice(held, piece(a) + 1, piece(b) - piece(a) + 1), ""), a % PIECE + 1, b - a)

        def marked(far: Column) -> Column:
            # A span begins a mark if it begins where all before have ended; the mark ends where the next begins or all have.
            new = lambda x, i: (i == 0) | (x["start"] >= F.get(far, i - 1))
            begins = F.filter(F.transform(spans, lambda x, i: F.when(new(x, i), F.struct(F.coalesce(F.get(far, i - 1), F.lit(0)).alias("a"), x["start"].alias("b")))), lambda x: x.isNotNull())
            head = F.array_join(F.transform(begins, lambda x: between(x["a"], x["b"])), mark)
            return F.concat(head, F.lit(mark), between(F.element_at(far, -1), F.length(text)))

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), marked)

    return F.when(F.size(spans) > 0, let(pieces, cut)).otherwise(text)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    def rows(pattern: str, group: int, keep: str, kind: int) -> str:
        p = pattern.replace("'", "''")
        gaps, all_, got = f"string_split_regex(body, '{p}')", f"regexp_extract_all(body, '{p}')", f"regexp_extract_all(body, '{p}', {group})"
        start = f"list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({all_}[1:i - 1], lambda m: length(m))), 0)"
        spans = f"list_transform(range(1, len({all_}) + 1), lambda i: {{'s': ({start})::BIGINT, 'k': {kind}, 'e': ({start} + length({all_}[i]))::BIGINT, 'v': {got}[i]}})"
        return f"list_filter({spans}, lambda x: {keep})"

    def bits(letters: str) -> str:
        part = f"substr(x.v, j, {WINDOW})"
        return f"list_max(list_transform(range(1, length(x.v) - {WINDOW} + 2), lambda j: -list_sum(list_transform(list_distinct(string_split({part}, '')), lambda c: ({WINDOW} - length(replace({part}, c, ''))) / {WINDOW}.0 * log2(({WINDOW} - length(replace({part}, c, ''))) / {WINDOW}.0)))))"

    allow = f"NOT regexp_matches(x.v, '{ALLOW[0]}') AND NOT regexp_matches(x.v, '{ALLOW[1]}') AND replace(x.v, x.v[1], '') <> ''"
    free = "len(list_filter(base, lambda b: x.s < b.e AND b.s < x.e)) = 0"
    extra = []
    for pattern, letters, kinds, least in CLASSES.values():
        mixed = " AND ".join(f"regexp_matches(x.v, '{k}')" for k in kinds)
        extra.append(f"list_filter({rows(pattern, 0, 'true', 3)}, lambda x: {mixed} AND {free} AND {allow} AND {bits(letters)} >= {least})")
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    join = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    cut = lambda spans: f"list_transform({spans}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})"
    base = f"list_concat(list_concat({rows(ASSIGN, 2, f'length(x.v) >= {ASSIGN_LEAST}', 0)}, {rows(ACCESS, 0, 'true', 1)}), {rows(HEX, 0, 'true', 2)})"
    count = lambda k: f"len(list_filter(base, lambda x: x.k = {k}))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT doc_id, body, {base} AS base FROM d),
e AS (SELECT doc_id, list_sort({cut('base')}) AS base, list_sort(list_distinct(list_concat({cut('base')}, {cut('list_concat(list_concat({}, {}), list_concat({}, {}))'.format(*extra))}))) AS spans FROM b)
SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, sha256({join('base')}) AS base_sha256, {join('spans')} AS spans FROM e"""


QUERIES = {"op10_secrets": op10_secrets}
ORACLE = {"op10_secrets": _sql()}
