"""Secret scans through a trigram inverted index, in DataFrame operations.

Each rule's regex yields a Boolean query over trigrams that every match must contain. Postings (trigram,
document) are written once for the trigrams that any rule asks for; a rule's candidates come from intersecting
and uniting them, and only candidates are verified by the regex. A rule without mandatory trigrams, such as a
run of hex digits, scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import small, table, written

parser = re._parser  # the parse tree of the standard library's own regexes

#: Strings that one part of a regex may stand for before it counts as unknown.
WIDE = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    The pattern must read alike in Java and in Python and must not look around: then a match's text, searched
    from the end of the match before it, is found just where the match is.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules of the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Maximal runs of one class: a run of 16 or more is a match just where it is one of [0-9a-f]+.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Shapes of widely used credentials.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    # Repeats before a later part are bounded: a crafted run cannot make the regex start over at each of its places.
    Rule("signed", r"eyJ[A-Za-z0-9_-]{1,500}\.eyJ[A-Za-z0-9_-]{1,8000}\.[A-Za-z0-9_-]+"),
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

#: A query is True (any text), a trigram, or ("and" | "or", its parts).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    if True in parts or not parts:
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The lower-case strings that a sequence can be, if few, and what every match of it must contain."""
    run: set[str] = {""}
    exact, must = True, []

    def stop() -> None:
        nonlocal run, exact
        must.append(_of(run))
        run, exact = {""}, False

    def take(strings: set[str] | None) -> bool:
        nonlocal run
        if strings is None or len(run) * len(strings) > WIDE:
            stop()
            return strings is not None and len(strings) <= WIDE and take(strings)
        run = {a + b for a, b in product(run, strings)}
        return True

    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            take({chr(arg).lower()})
        elif name == "IN":
            chars = {chr(c).lower() for kind, c in arg if str(kind) == "LITERAL"}
            take(chars if len(chars) <= 8 and all(str(kind) == "LITERAL" for kind, _ in arg) else None)
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3])
            must.append(query if strings is None else True)
            take(strings)
        elif name == "BRANCH":
            found = [_walk(branch) for branch in arg[1]]
            if all(s is not None for s, _ in found):
                take(set().union(*(s for s, _ in found)))
            else:
                must.append(_any([q if s is None else _of(s) for s, q in found]))
                take(None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, what = arg
            strings, query = _walk(what)
            if strings is not None and (low, high) == (0, 1):
                take(strings | {""})
                continue
            if low and strings is None:
                must.append(query)
            for _ in range(min(low, 3)):
                take(strings)
            if (low, high) not in ((1, 1), (2, 2), (3, 3)):
                stop()
        elif name != "AT":
            take(None)
    must.append(_of(run))
    return (run if exact else None), _all(must)


def trigram_query(pattern: str) -> Query:
    """What the lower-case text of every match of ``pattern`` must contain; True if nothing."""
    return _walk(parser.parse(pattern))[1]


def terms_of(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(terms_of, query[1:]))


def _holds(query: Query, has: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return has[query]
    parts = [_holds(q, has) for q in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def any_term(terms: list[str]) -> str:
    """A pattern that captures the term at each place of a text; a trie of the terms, so that most places fail at once."""

    def trie(tails: list[str]) -> str:
        if tails == [""]:
            return ""
        by_first = {c: sorted(t[1:] for t in tails if t[0] == c) for c in sorted({t[0] for t in tails})}
        parts = [re.escape(c) + trie(rest) for c, rest in by_first.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    firsts = "".join(re.escape(c) for c in sorted({t[0] for t in terms}))
    return f"(?=[{firsts}])(?=({trie(sorted(terms))}))"


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index: rows ``term, doc_id``, on shared files. One pass over each text finds the terms it holds."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_term(terms)), F.lit(1)))
    return written(docs.select(F.explode(held).alias("term"), "doc_id"), "postings")


def candidates(index: DataFrame, terms: list[str], queries: list[Query]) -> DataFrame:
    """``doc_id, rules``: the places in ``queries`` of those that hold for the document's postings."""
    got = index.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    has = {t: F.array_contains("terms", t) for t in terms}
    rules = F.array_compact(F.array(*[F.when(_holds(q, has), F.lit(i)) for i, q in enumerate(queries)]))
    return got.select("doc_id", rules.alias("rules")).where(F.size("rules") > 0)


def running(numbers: Column) -> Column:
    """The running sums of an array, by doubling: as many passes as its size has bits, none of them grows an array."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1)).cast("int"))

    def doubled(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(rounds, numbers, doubled)


def _spans(rule: Rule, order: int, active: Column) -> Column:
    """Spans of one rule in ``text`` as an array of (start, order, end, kind), in code points.

    What lies between the matches tells where they are: a match ends behind all text and matches up to it. So the work
    is that of a few passes over the text and over its matches, however many there are.
    """
    pattern = F.lit(f"({rule.pattern})")
    whole = F.regexp_extract_all("text", pattern, F.lit(1))
    asked = F.regexp_extract_all("text", pattern, F.lit(rule.group + 1))
    sizes = F.transform(whole, F.length)

    def placed(sizes: Column) -> Column:
        steps = F.zip_with(F.slice(F.transform(F.split("text", F.lit(rule.pattern), -1), F.length), F.lit(1), F.size(sizes)), sizes, lambda gap, size: gap + size)
        ends = running(steps)
        kept = F.transform(F.arrays_zip(ends.alias("end"), sizes.alias("size"), F.transform(asked, F.length).alias("asked")), lambda m: F.struct((m["end"] - m["size"]).alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(rule.kind).alias("kind"), m["asked"].alias("asked")))
        kept = F.filter(kept, lambda m: m["asked"] >= rule.least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["order"].alias("order"), m["end"].alias("end"), m["kind"].alias("kind")))

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    found = F.transform(F.array(sizes), lambda s: F.when(F.size(s) > 0, placed(s)).otherwise(none))[0]
    return F.coalesce(F.when(active, found), none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id``, ``n_<kind>`` of each base rule, ``base_sha256``, ``spans``.

    Spans are ``kind:start:end`` in code points, by start, then in the order of the rules. Null counts as empty:
    no spans. Rows that repeat a doc_id are each scanned; a null doc_id is an id like any other; an empty table
    gives no rows; other columns are not read. Candidates are broadcast only if their count proves them small.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rules = [*base, *more]
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if q is not True]
    terms = sorted(set().union(*(terms_of(queries[i]) for i in indexed)))
    if indexed:
        found = written(candidates(postings(docs, terms), terms, [queries[i] for i in indexed]), "candidates")
        found = small(found.withColumnRenamed("doc_id", "_id"), found.count())
        docs = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    for i, rule in enumerate(rules):
        active = F.array_contains("rules", indexed.index(i)) if i in indexed else F.lit(True)
        docs = docs.withColumn(f"_{i}", _spans(rule, i, active))
    counts = [F.size(f"_{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)]
    mine = F.concat(*[F.col(f"_{i}") for i in range(len(base))])
    every = F.concat(*[F.col(f"_{i}") for i in range(len(rules))])
    return docs.select("doc_id", *counts, F.sha2(_joined(mine), 256).alias("base_sha256"), _joined(every).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
