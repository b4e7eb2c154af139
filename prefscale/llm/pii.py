"""Personal data, by built-in functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs, value ranges for
addresses), and context words before a span move its score. The four base kinds stay whatever their score; the added
kinds (iban, ssn) stay when their score reaches ``threshold`` and they overlap no base span.

Positions are code points. Spark has no function for them, so they come from the lengths of what stands between
matches (split) and of the matches (regexp_extract_all), both found by the same scan. The patterns are the contract's
with possessive repeats and a look at the character before, which take linear time, never recurse on long runs and
match the same spans.

Cases. A null text counts as empty for ``find`` and stays null in ``redact``. Rows are judged each for itself, repeated
or not, with an id or without. Spans that start at the same place come in the order of kinds. Texts may be of any length
and are read whole. Other columns pass; ``find`` replaces one with the name of its result, ``redact`` the text alone. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: kind -> (pattern, cheap test that a text may hold it).
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

#: kind -> (score of a confirmed span, words that raise it when they stand shortly before, by how much).
SCORES = {
    "email": (0.9, r"e-?mail|contact|write", 0.1),
    "ip": (0.6, r"\bip\b|address|server|host", 0.3),
    "card": (0.8, r"card|visa|credit|karte|tarjeta|carte", 0.2),
    "phone": (0.7, r"phone|tel|call|mobile|fax", 0.2),
    "iban": (0.8, r"iban|account|konto|cuenta|compte", 0.2),
    "ssn": (0.3, r"ssn|social security", 0.5),
}
CONTEXT_CHARS = 40
THRESHOLD = 0.5
_BLOCK = 256


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a column named in a lambda may be computed for each of its calls."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _located(gaps: Column, matches: Column) -> Column:
    """array<struct<m, s>>: each match and its start. Sums in blocks keep the work near linear for very many matches."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"), m.alias("m")))

    def cut(both: Column) -> Column:
        last = F.floor((F.size(both) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(both, b * _BLOCK + 1, F.lit(_BLOCK)))

    def lengths(block: Column) -> Column:
        return F.transform(block, lambda x: x["g"] + F.coalesce(x["l"], F.lit(0)))

    def place(blocks: Column, before: Column) -> Column:
        def own(block: Column, b: Column) -> Column:
            def at(known: Column) -> Column:
                return F.transform(block, lambda x, i: F.struct(x["m"].alias("m"), (F.get(before, b) + _total(F.slice(known, F.lit(1), i)) + x["g"]).alias("s")))

            return _let(lengths(block), at)

        return F.filter(F.flatten(F.transform(blocks, own)), lambda x: x["m"].isNotNull())

    def offsets(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: _total(lengths(x)))
        return _let(sums, lambda t: F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b))))

    return _let(_let(steps, cut), lambda blocks: _let(offsets(blocks), lambda before: place(blocks, before)))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return _total(F.transform(F.sequence(F.lit(1), n), value)) % 10 == 0


def _mod97(iban: Column) -> Column:
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c) - 48
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _clear(kind: str, text: Column, start: Column, end: Column) -> Column:
    """Added kinds stand alone: no letter, digit or joining hyphen touches them."""
    if kind in BASE:
        return F.lit(True)
    touch = "[A-Za-z0-9]" if kind == "iban" else "[0-9-]"
    prior = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    return ~prior.rlike(touch) & ~F.substr(text, end + 1, F.lit(1)).rlike(touch)


def _overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))


def _test(kind: str):
    return lambda x: _confirmed(kind, x["m"])


def _scored(kind: str, text: Column):
    least, words, more = SCORES[kind]

    def span(x: Column) -> Column:
        start = x["s"]
        since = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substr(text, since + 1, start - since)).rlike(words)
        score = F.lit(least) + F.when(near, F.lit(more)).otherwise(0.0)
        end = start + F.length(x["m"])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return span


def _alone(kind: str, text: Column, base: Column, threshold: float):
    return lambda x: (x["score"] >= threshold) & _clear(kind, text, x["start"], x["end"]) & ~_overlaps(x, base)


def find(docs: DataFrame, column: str = "text", threshold: float = THRESHOLD, into: str = "pii") -> DataFrame:
    """docs with array<struct<start, kind_no, end, kind, score>> of all spans, by start and then kind."""
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    docs = docs.select(*kept)
    stem = "_pii"
    while any(c.lower().startswith(stem) for c in kept):
        stem += "_"
    names = {k: f"{stem}_{k}" for k in KINDS}
    out = docs.withColumn(f"{stem}_text", F.coalesce(F.col(column), F.lit("")))
    text = F.col(f"{stem}_text")
    none = F.array().cast("array<string>")
    for k, (pattern, hint) in PATTERNS.items():
        may = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
        out = out.withColumn(f"{names[k]}_m", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for k, (pattern, _) in PATTERNS.items():
        m = F.col(f"{names[k]}_m")
        out = out.withColumn(f"{names[k]}_g", F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>")
    for k in KINDS:
        m, g = F.col(f"{names[k]}_m"), F.col(f"{names[k]}_g")
        found = F.filter(_located(g, m), _test(k))
        out = out.withColumn(names[k], F.when(F.size(m) > 0, F.transform(found, _scored(k, text))).otherwise(empty))
    def whole(base: Column) -> Column:
        added = (F.filter(F.col(names[k]), _alone(k, text, base, threshold)) for k in KINDS if k not in BASE)
        return F.array_sort(F.concat(base, *added))

    return out.withColumn(into, _let(F.concat(*(F.col(names[k]) for k in BASE)), whole)).select(*docs.columns, into)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """docs with each span of the text, overlapping spans as one, replaced by its kind in brackets."""
    into = free_name(docs, "_found")
    out = find(docs, column, into=into, **options)
    spans, text = F.col(into), F.col(column)

    def cut(ends: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.array_max(F.slice(ends, F.lit(1), F.greatest(i, F.lit(1))))).otherwise(0)
            kept = F.substr(text, before + 1, F.greatest(x["start"] - before, F.lit(0)))
            return F.when((i > 0) & (x["start"] < before), F.lit("")).otherwise(F.concat(kept, F.lit("["), F.upper(x["kind"]), F.lit("]")))

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(text, F.array_max(ends) + 1))

    done = _let(F.transform(spans, lambda x: x["end"]), cut)
    return out.withColumn(column, F.when(F.size(spans) > 0, done).otherwise(text)).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind_no"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
    )


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": PATTERNS["iban"][0],
        "ssn": PATTERNS["ssn"][0],
    }
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    iban = "replace(m, ' ', '')"
    turned = f"({iban}[5:] || {iban}[1:4])"
    luhn = f"""list_sum([CASE WHEN i % 2 = 1 THEN v WHEN 2 * v > 9 THEN 2 * v - 9 ELSE 2 * v END
                FOR v, i IN list_reverse([CAST(c AS INT) FOR c IN string_split({d}, '')])]) % 10 = 0"""
    test = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0",
        "card": f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({d}) BETWEEN 9 AND 15",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    }
    test["iban"] = f"""CASE WHEN length({iban}) BETWEEN 15 AND 34 THEN list_reduce(
        list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split({turned}, '')]),
        lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1 ELSE false END"""
    parts = []
    for n, k in enumerate(KINDS):
        least, words, more = SCORES[k]
        free = "true"
        if k not in BASE:
            touch = "[A-Za-z0-9]" if k == "iban" else "[0-9-]"
            free = f"""NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END, '{touch}')
                AND NOT regexp_matches(substr(text, s + length(m) + 1, 1), '{touch}')
                AND {least} + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0))), '{words}')
                    THEN {more} ELSE 0 END >= {THRESHOLD}"""
        parts.append(f"""
SELECT row, {n} AS kind_no, '{k}' AS kind, s, s + length(m) AS e FROM (
  SELECT row, text, ms[i] AS m, CAST(list_sum([length(x) FOR x IN gs[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT row, text, regexp_extract_all(text, '{plain[k]}') AS ms, string_split_regex(text, '{plain[k]}') AS gs FROM d)))
WHERE {test[k]} AND {free}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
c AS ({" UNION ALL ".join(parts)}),
b AS (SELECT * FROM c WHERE kind_no < {len(BASE)}),
a AS (SELECT * FROM b UNION ALL SELECT * FROM c WHERE kind_no >= {len(BASE)}
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = c.row AND b.s < c.e AND c.s < b.e)),
g AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
        coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no, e) FILTER (kind_no < {len(BASE)}), '') AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no, e) AS spans
      FROM a GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


ORACLE = _sql()
