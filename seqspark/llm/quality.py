"""Quality rules by distribution divergence. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table, word_array

LEAST_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"

# Common words of languages, the most frequent function words of each.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "at", "are", "from", "not", "have", "or", "an", "which"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "für", "bei"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "il", "pas", "ne", "se", "ce", "ou", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "o", "más", "si"),
}
#: Classes of characters; what is in none counts as other. Order is that of the histograms.
CHARACTER_CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("point", r"[.,;:!?'\"()-]+"), ("symbol", r"[#*$%&|<>@=+/_~^\\\[\]{}]+"))

#: (words at least, how far the characters may be from the reference): Jensen-Shannon distances with base 2, from 0 to 1.
GUARDS = ((50, 0.32), (400, 0.25))
#: (words at least, a, b, c): common words may be max(a, b + c / sqrt(words)) from the reference, as a histogram strays by chance by what shrinks
#: with the root of its words. Only where the language is known: words of one language lie far from those of all together.
WORD_GUARD = (100, 0.235, 0.08, 3.4)
#: (words at least, characters, a, b, c): the same for documents that are beyond both distances at once.
BOTH = (75, 0.125, 0.22, 0.1, 2.6)
PUNCTUATION = ".,;:!?"


def vocabulary(common: dict = COMMON_WORDS) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Each is worked out within its row, without a shuffle. Where a text has fewer distinct 3-word windows than windows, these are
    found by sorting their hashes with their places: equal neighbours repeat, and the words that they cover are counted from the
    sorted places.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("words", word_array(F.col(text)))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("_joined", F.array_join("words", ""))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("_spans", F.slice(hashes, 1, F.greatest(F.size("words") - 2, F.lit(0))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x))
    counted = lambda s: F.aggregate(
        F.sort_array(F.transform(twice(s), lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    ordered = F.sort_array(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_spans")) < F.size("_spans")
    covered = F.when(repeats, F.get(F.transform(F.array(ordered), counted), F.lit(0))).otherwise(F.lit(0)).cast("long")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        *[c for c in rows.columns if c not in ("_spans", "_joined")],
        "_joined",
        F.length("_joined").cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(body, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        F.when(F.instr(body, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def histograms(rows: DataFrame, text: str = "text", common: dict = COMMON_WORDS) -> DataFrame:
    """Adds chars and commons: arrays of counts by character class and by common word, the last place being all else."""
    out, left = rows.withColumn("_l0", F.col("_joined")), "_l0"
    for k, (_, pattern) in enumerate(CHARACTER_CLASSES):
        out, left = out.withColumn(f"_l{k + 1}", F.regexp_replace(left, pattern, "")), f"_l{k + 1}"
    sizes = [F.length(f"_l{k}") for k in range(len(CHARACTER_CLASSES) + 1)]
    chars = F.array(*[(a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1].cast("long"))
    plain = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20.,;:!?\x09-\x0D]+", -1)
    words = vocabulary(common)
    # Only common words stay, one letter for each, so that taking one letter away shortens the string by its count.
    letter = {w: chr(33 + k if k < 90 else 256 + k) for k, w in enumerate(words)}
    of = F.create_map(*[F.lit(x) for pair in letter.items() for x in pair])
    out = out.withColumn("_c", F.array_join(F.transform(F.filter(plain, lambda w: w.isin(words)), lambda w: F.element_at(of, w)), ""))
    each = [(F.length("_c") - F.length(F.replace("_c", F.lit(x), F.lit("")))).cast("long") for x in letter.values()]
    out = out.withColumn("chars", chars).withColumn("_w", F.array(*each))
    rest = F.greatest(F.col("n_words") - F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    out = out.withColumn("commons", F.concat("_w", F.array(rest)))
    return out.drop("_c", "_w", "_joined", *[f"_l{k}" for k in range(len(CHARACTER_CLASSES) + 1)])


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)


def divergence(p: Column, p_total: Column, q: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, whose totals are given as columns so that they are added up once; null if
    either has none."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2)
    terms = F.zip_with(p, q, lambda x, y: both(x / p_total, y / q_total))
    return F.when((p_total > 0) & (q_total > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))


def references(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, ref_chars, ref_commons): the sums of all documents of each language; null lang sums over all documents."""
    n_chars, n_words = len(CHARACTER_CLASSES) + 1, len(vocabulary()) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).cast("double").alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get("commons", F.lit(i))).cast("double").alias(f"w{i}") for i in range(n_words)]
    by = rows.groupBy(F.col(lang).alias("ref_lang")).agg(*sums)
    every = by.agg(*[F.sum(c).alias(c) for c in by.columns[1:]]).select(F.lit(None).cast("string").alias("ref_lang"), *by.columns[1:])
    both = by.where("ref_lang IS NOT NULL").unionByName(every)
    return both.select("ref_lang", F.array(*[f"c{i}" for i in range(n_chars)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(n_words)]).alias("ref_commons"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, guards: tuple = GUARDS, word_guard: tuple = WORD_GUARD, both: tuple = BOTH) -> DataFrame:
    """One row for each row of docs: doc_id, lang, the base features, base_failed, char_distance, word_distance, kept.

    The reference of a language is the histogram over all its documents; documents without a language are held against all.
    A document is kept unless base_failed, or it has the words of a guard and lies further from its reference than the guard
    allows: by the characters, by the common words (more room for fewer words), or by both at once. Without a language only the characters count.
    Null and empty texts fail the base; an empty table gives no rows; repeated rows are judged alike and each count
    in the reference. Distances are null where there is nothing to compare, which is no reason to reject.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = settle(histograms(base_features(rows)).drop("words", "text"), "quality")
    refs = settle(references(counted), "quality")
    near = counted.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    names = ("chars", "commons", "ref_chars", "ref_commons")
    near = near.select("*", *[total(F.col(c)).alias(f"{c}_total") for c in names])
    apart = lambda c: divergence(F.col(c), F.col(f"{c}_total"), F.col(f"ref_{c}"), F.col(f"ref_{c}_total"))
    near = near.select("*", apart("chars").alias("char_distance"), apart("commons").alias("word_distance"))
    near = near.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    chars, commons, n = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0)), F.col("n_words")
    far = F.lit(False)
    for words, most in guards:
        far = far | ((n >= words) & (chars > most))
    room = lambda a, b, c: F.greatest(F.lit(a), F.lit(b) + F.lit(c) / F.sqrt(n))
    known = ((n >= word_guard[0]) & (commons > room(*word_guard[1:]))) | ((n >= both[0]) & (chars > both[1]) & (commons > room(*both[2:])))
    far = far | (F.col("lang").isNotNull() & known)
    return near.withColumn("kept", ~F.col("base_failed") & ~far).drop("ref_lang", *names, *[f"{c}_total" for c in names])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    words = vocabulary()
    quoted = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    listed = quoted.replace("[", "(").replace("]", ")")
    names = [k for k, _ in CHARACTER_CLASSES]
    lefts, at = [], "joined"
    for k, (_, pattern) in enumerate(CHARACTER_CLASSES):
        lefts.append(f"l{k} AS (SELECT *, regexp_replace({at}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{k} FROM {'j' if not k else f'l{k - 1}'})")
        at = f"r{k}"
    steps = ["joined", *[f"r{k}" for k in range(len(names))]]
    chars = ", ".join([f"(length({a}) - length({b}))::DOUBLE" for a, b in zip(steps, steps[1:], strict=False)] + [f"length({steps[-1]})::DOUBLE"])
    n_chars, n_words = len(names) + 1, len(words) + 1
    jsd = lambda a, b, n: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: "
        f"(CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2({a}[i] / list_sum({a}) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0.0 END) + "
        f"(CASE WHEN {b}[i] > 0 THEN {b}[i] / list_sum({b}) * log2({b}[i] / list_sum({b}) / (({a}[i] / list_sum({a}) + {b}[i] / list_sum({b})) / 2)) ELSE 0.0 END))) / 2)) END"
    )
    room = lambda a, b, c: f"greatest({a}, {b} + {c} / sqrt(n_words))"
    far = " OR ".join(f"(n_words >= {n} AND coalesce(cd, 0) > {c})" for n, c in GUARDS)
    known = f"(n_words >= {WORD_GUARD[0]} AND coalesce(wd, 0) > {room(*WORD_GUARD[1:])}) OR (n_words >= {BOTH[0]} AND coalesce(cd, 0) > {BOTH[1]} AND coalesce(wd, 0) > {room(*BOTH[2:])})"
    far += f" OR (lang IS NOT NULL AND ({known}))"
    sums = lambda e: ", ".join([f"sum(chars[{i}])" for i in range(1, n_chars + 1)]) if e == "c" else ", ".join(f"sum(commons[{i}])" for i in range(1, n_words + 1))
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
s AS (SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS wins FROM w),
u AS (SELECT doc_id, unnest(wins) AS win, unnest(range(len(wins))) AS i FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM u) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
j AS (SELECT s.doc_id, lang, body, len(words)::BIGINT AS n_words, array_to_string(words, '') AS joined, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  list_filter(string_split(translate(lower(body), '{PUNCTUATION}' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '{" " * (len(PUNCTUATION) + 5)}'), ' '), lambda x: x IN {listed}) AS hits FROM s LEFT JOIN p USING (doc_id)),
{", ".join(lefts)},
h AS (SELECT *, [{chars}] AS chars, list_transform({quoted}, lambda v: len(list_filter(hits, lambda x: x = v))::DOUBLE) AS cw FROM l{len(names) - 1}),
g AS (SELECT *, list_append(cw, greatest(n_words - list_sum(cw), 0)::DOUBLE) AS commons FROM h),
ref AS (SELECT lang, [{sums('c')}] AS rc, [{sums('w')}] AS rw FROM g WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT NULL, [{sums('c')}], [{sums('w')}] FROM g),
f AS (SELECT g.*, {jsd('chars', 'rc', n_chars)} AS cd, {jsd('commons', 'rw', n_words)} AS wd FROM g LEFT JOIN ref ON g.lang IS NOT DISTINCT FROM ref.lang)
SELECT doc_id, n_words, coalesce(length(joined), 0)::BIGINT AS word_chars, (length(body) - length(regexp_replace(body, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, n_repeat_words,
 (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT ({far}) AS kept FROM f"""


QUERIES = {"op1_quality": op1_quality}
ORACLE = {"op1_quality": _sql()}
