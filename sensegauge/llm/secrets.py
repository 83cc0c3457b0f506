"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams: alternatives (or) of sets of trigrams (and)
that any match holds. Postings (trigram, document) of the trigrams in these queries are intersected; the rule's
expression then runs on its candidates only. A rule without mandatory trigrams runs on every text.

Spans are in code points, from the gaps between matches and the matches' lengths. Matches are leftmost and do not
overlap within a rule.

Defined results: null and empty texts have no spans (the digest is that of the empty string); repeated rows are scanned
each; rows with equal doc_id share their candidates, which changes no result; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C  # the standard library's own parser of expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.shared import cut, few


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    #: Group whose match must have this many characters (code points) at least.
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", True, 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

#: Strings that one part of an expression is spelled out into at most.
_SPELLED = 64


def _spell(items) -> set[str] | None:
    """All strings that a sequence can match, lower-case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            part = _spell(arg[3])
        elif op is C.BRANCH:
            parts = [_spell(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op is C.IN:
            part = {chr(a).lower() for o, a in arg if o is C.LITERAL} if all(o is C.LITERAL for o, _ in arg) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2 and (own := _spell(arg[2])) is not None:
            part = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(own, repeat=n)}
        else:
            part = None
        if part is None or len(out) * len(part) > _SPELLED:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (lower-case), one of which any match has in full; an empty list if there is none."""
    best: list[frozenset[str]] = []
    run: list = []

    def close() -> None:
        nonlocal best
        strings = _spell(run)
        if run and strings and min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            query = sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query

    for item in _parser.parse(pattern):
        if _spell([*run, item]) is None:
            close()
            run = [] if _spell([item]) is None else [item]
        else:
            run.append(item)
    close()
    return best


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules: by rule kind, the documents that have all trigrams of an alternative. One row a document that has any."""
    clauses = [(r.kind, f"{r.kind}:{i}", g, len(clause)) for r in rules for i, clause in enumerate(trigram_query(r.pattern)) for g in sorted(clause)]
    grams = F.array(*(F.lit(g) for g in sorted({c[2] for c in clauses})))
    # array() of one text, so that it is lower-cased once and not for each trigram
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(grams, lambda g: F.contains(t, g)))[0]
    postings = docs.select(key(), F.explode(held).alias("gram")).distinct()
    # the queries are fixed by the rules, some hundred rows
    queries = docs.sparkSession.createDataFrame(clauses, "rule string, clause string, gram string, need int")
    met = postings.join(F.broadcast(queries), "gram").groupBy("key", "rule", "clause", "need").agg(F.count("*").alias("have")).where("have = need")
    return met.groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # as many as there are rules, at most


def key() -> Column:
    return F.xxhash64("doc_id").alias("key")


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, kind, stop)."""
    rx = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.transform(F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("v")), lambda x: F.struct(F.length(x["m"]).alias("n"), F.length(x["v"]).alias("v")))
    each = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("m"))
    none = F.expr("cast(array() as array<struct<start: int, ord: int, kind: string, stop: int>>)")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        stop = start + x["m"]["n"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["m"]["v"] >= rule.least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.when(F.rlike(text, rx), F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (start, ord, kind, stop) by start, then rule."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = cut(candidates(docs, rules)).withColumnRenamed("key", "key_c")
    found = F.broadcast(found) if few(found) else found
    joined = docs.join(found, F.xxhash64("doc_id") == F.col("key_c"), "left")
    none = F.expr("cast(array() as array<struct<start: int, ord: int, kind: string, stop: int>>)")
    parts = []
    for i, r in enumerate(rules):
        own = spans(F.col("text"), r, i)
        parts.append(F.when(F.coalesce(F.array_contains("rules", r.kind), F.lit(False)), own).otherwise(none) if trigram_query(r.pattern) else own)
    return joined.select("doc_id", F.array_sort(F.flatten(F.array(*parts))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
