"""Secret scan by a trigram inverted index, in DataFrame expressions only.

Every rule's regex is taken apart into a Boolean query over trigrams that each match must
contain (an OR of ANDs over lower-cased text). The index holds postings (trigram, row
key) for the trigrams that the queries name. Postings are intersected clause by clause
with a grouped count, and only the rows that fulfil a clause are verified with the regex.
A rule whose matches need no trigram (a run of hexadecimal digits) scans every text.

Rules are regexes that Java, Python and RE2 read alike. Positions are code points. Null
texts are empty and have no findings; repeated rows each have theirs.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, own_name, running


@dataclass(frozen=True)
class Rule:
    """group/least: a match counts if that group has so many code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds that the first digest covers.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Prefixes and lengths that the issuers of these credentials publish.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Strings that a part of a regex may stand for before it is cut into trigrams.
MAX_STRINGS = 64
#: Clauses of a query beyond which an AND keeps its more selective side.
MAX_CLAUSES = 32

#: A query: any of these sets of trigrams has to be there; None: nothing is mandatory.
Query = frozenset[frozenset[str]] | None


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    both = frozenset(x for x in both if not any(y < x for y in both))
    return both if len(both) <= MAX_CLAUSES else min(a, b, key=len)


def _or(queries: list[Query]) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    every = set().union(*queries)
    found = frozenset(x for x in every if not any(y < x for y in every))
    return found if len(found) <= MAX_CLAUSES else None


def _of_strings(strings: set[str]) -> Query:
    return _or([frozenset([frozenset(s[k : k + 3] for k in range(len(s) - 2))]) if len(s) >= 3 else None for s in strings])


def _strings(op, arg) -> set[str] | None:
    """The few strings that a node matches, lower-cased; None: too many or unknown."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if len(chr(arg).lower()) == 1 and arg < 128 else None
    if op is C.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < MAX_STRINGS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is C.BRANCH:
        each = [_sequence(x)[0] for x in arg[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _node(op, arg) -> Query:
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is C.BRANCH:
        return _or([_sequence(x)[1] for x in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])[1]
    return None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """(all strings of the sequence or None, its query)."""
    run, query, whole = {""}, None, True
    for op, arg in nodes:
        if op is C.AT:
            continue
        found = _strings(op, arg)
        if found is not None and len(found) * len(run) <= MAX_STRINGS:
            run = {a + b for a, b in itertools.product(run, found)}
        else:
            query, whole = _and(_and(query, _of_strings(run)), _node(op, arg) if found is None else _of_strings(found)), False
            run = {""} if found is None else found
    return (run if whole else None), _and(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` fulfils, over lower-cased text."""
    return _sequence(_parser.parse(pattern))[1]


def postings(rows: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, key) for each of ``trigrams`` in the lower-cased text of a row."""
    low = rows.select(key, F.lower(text).alias("low"))
    each = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select(key, F.explode(F.array_compact(each)).alias("trigram"))


def candidates(index: DataFrame, key: str, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules of which a clause is fulfilled, by intersecting postings.

    The clauses are a table of fixed size that comes from the rules.
    """
    spark = index.sparkSession
    clauses = [(kind, n, t, 1 << k, (1 << min(63, len(clause))) - 1) for kind, q in queries.items() for n, clause in enumerate(sorted(q, key=sorted)) for k, t in enumerate(sorted(clause)[:63])]
    needed = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, trigram string, bit long, every long"))
    met = index.join(needed, "trigram").groupBy(key, "kind", "clause", "every").agg(F.bit_or("bit").alias("found")).where("found = every")
    return met.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of leftmost non-overlapping matches, from the pieces between them."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    zipped = F.arrays_zip(gaps.alias("gap"), lengths.alias("size"), kept.alias("keep"))

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))))

        def spans(before: Column) -> Column:
            each = F.transform(pieces, lambda x, i: F.struct((F.get(before, i) + x["gap"]).cast("int").alias("start"), (F.get(before, i) + x["gap"] + x["size"]).cast("int").alias("end"), x["keep"].alias("keep")))
            return F.transform(F.filter(each, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

        return let(ends, spans)

    return let(zipped, placed)


def _spans(text: Column, rule: Rule, place: int, asked: Column) -> Column:
    made = F.transform(_matches(text, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return F.when(asked & text.rlike(rule.pattern), made).otherwise(none)


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, out: str = "secrets") -> DataFrame:
    """``docs`` without ``text``, with the array ``secrets`` of (start, end, kind) by start, then rule.

    One row for each row of ``docs``; null and empty texts have no findings. Rows that
    repeat are scanned together. A column of ``docs`` named as ``out`` is kept: the new
    one gets a number.
    """
    out, key = own_name(docs, out), own_name(docs, "row_key")
    rest = [c for c in docs.columns if c != text]
    body = own_name(docs, "body")
    rows = docs.withColumns({body: F.coalesce(F.col(text), F.lit("")), key: F.xxhash64(text)}).drop(text)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    free = [(n, r) for n, r in enumerate(rules) if queries[r.kind] is None]
    direct = F.flatten(F.array(*[_spans(F.col(body), r, n, F.lit(True)) for n, r in free])) if free else None
    trigrams = sorted(set().union(*[c for q in indexed.values() for c in q])) if indexed else []
    found = candidates(postings(rows.select(key, body), key, body, trigrams), key, indexed) if trigrams else None
    if found is None:
        return rows.select(*rest, _named(F.coalesce(direct, F.array()), out))
    found = cut(found)
    some = rows.select(key, body).join(found, key)
    held = F.array(*[_spans(F.col(body), r, n, F.array_contains("kinds", r.kind)) for n, r in enumerate(rules) if r.kind in indexed])
    digest = F.sha2(body, 256)  # two texts with one key stay apart
    verified = some.select(F.col(key), digest.alias("digest"), F.flatten(held).alias("spans")).where(F.size("spans") > 0).dropDuplicates([key, "digest"])
    slim = rows.select(*rest, key, *([direct.alias("own_spans")] if free else []), F.when(F.length(body) > 0, digest).alias("own_digest"))
    met = slim.join(verified.withColumnRenamed(key, "other_key"), (F.col(key) == F.col("other_key")) & (F.col("own_digest") == F.col("digest")), "left")
    every = F.concat(*([F.col("own_spans")] if free else []), F.coalesce("spans", F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")))
    return met.select(*rest, _named(every, out))


def _named(spans: Column, out: str) -> Column:
    return F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias(out)


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql_spans(rule: Rule, place: int) -> str:
    """DuckDB: list of (start, place, end, kind) of a rule's matches in ``body``."""
    p = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(body, '{p}')) + 1), lambda i: {{
        'start': CAST(coalesce(list_sum(list_transform(string_split_regex(body, '{p}')[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(body, '{p}')[1:i - 1], lambda g: length(g))), 0) AS BIGINT),
        'place': {place},
        'end': CAST(coalesce(list_sum(list_transform(string_split_regex(body, '{p}')[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(body, '{p}')[1:i], lambda g: length(g))), 0) AS BIGINT),
        'kind': '{rule.kind}', 'keep': length(regexp_extract_all(body, '{p}', {rule.group})[i]) >= {rule.least}}}), lambda s: s.keep)"""


def oracle() -> str:
    """The same result in DuckDB's SQL: every rule scans every text."""
    lists = ", ".join(_sql_spans(r, n) for n, r in enumerate(BASE + MORE))
    text = "array_to_string(list_transform({0}, lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"
    base = " OR ".join(f"s.kind = '{r.kind}'" for r in BASE)
    counts = ", ".join(f"CAST(len(list_filter(found, lambda s: s.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        spans AS (SELECT doc_id, list_sort(flatten([{lists}])) AS found FROM docs)
        SELECT doc_id, {counts}, sha256({text.format(f"list_filter(found, lambda s: {base})")}) AS base_sha256, {text.format("found")} AS spans FROM spans"""
