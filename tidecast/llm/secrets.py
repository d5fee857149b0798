"""Secret scan: rules are regular expressions, found through an inverted index of the trigrams that they need."""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import own_name, small, stored, table, text_key

#: Alternatives that are spelled out before a part of an expression counts as free.
SPELLED = 64
WORD_BITS = 60


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters; other matches are dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The kinds of the contract. A run of 16 digits at least is the same as any run, short ones dropped.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: A private key in armour: from its first line to its last if no other such line is between; without a last line,
#: its headers and the base64 run. Possessive, so that long keys need no stack.
_KEY = r"[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
_HEADERS = r"(?:[ \t\r\n>]*+(?:Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset): [^\n\\]{0,200}+)*+"
_BODY = (
    r"""(?:(?:\\[rnt]|[ \t\r\n"'`>|,;#*])*+[A-Za-z0-9+/=]{20,}+"""
    r"""|[ \t\r>]*+(?:\n|\\n)[ \t>]*+[A-Za-z0-9+/=]++(?=[ \t\r]*+(?![^\n"'\\])))*+"""
)
PEM = rf"-----BEGIN {_KEY}(?:(?:[^-]++|-(?!----))*+-----END {_KEY}|{_HEADERS}{_BODY})"
#: Kinds that the method adds.
ADDED = (
    Rule("pem", PEM),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


# --- trigram queries -------------------------------------------------------------------------------------------------
# A query is True (anything), a trigram, or ("and" | "or", frozenset of queries).


def _join(word: str, parts) -> object:
    parts = frozenset(parts)
    if word == "and":
        parts -= {True}
        flat = frozenset(x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)))
        return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)
    if True in parts:
        return True
    atoms = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    kept = [p for p in parts if not any(atoms[q] < atoms[p] for q in parts)]  # what asks for more adds nothing
    return kept[0] if len(kept) == 1 else ("or", frozenset(kept))


def _needs(texts: set[str]) -> object:
    """Any of the texts is there; True if one of them is too short to ask for."""
    grams = lambda t: _join("and", (t[i : i + 3] for i in range(len(t) - 2)))
    return _join("or", (grams(t) for t in texts)) if texts else True


def _walk(parts) -> tuple[set[str] | None, object]:
    """All texts that a sequence can match, if they are few; else None. With it, what every match needs."""
    run, needs, whole = {""}, [], True
    for op, value in parts:
        texts, inner = _one(op, value)
        if texts is not None and len(run) * len(texts) <= SPELLED:
            run = {a + b for a, b in product(run, texts)}
            continue
        needs += [_needs(run), _needs(texts) if texts is not None else inner]
        run, whole = {""}, False
    if whole:
        return run, True
    return None, _join("and", [*needs, _needs(run)])


def _one(op, value) -> tuple[set[str] | None, object]:
    if op is kinds.LITERAL:
        return {chr(value).lower()}, True
    if op is kinds.AT:
        return {""}, True
    if op is kinds.IN:
        found: set[str] = set()
        for what, x in value:
            if what is kinds.LITERAL:
                found.add(chr(x).lower())
            elif what is kinds.RANGE and x[1] - x[0] < SPELLED:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if op is kinds.SUBPATTERN:
        return _walk(value[-1])
    if op is kinds.BRANCH:
        ways = [_walk(x) for x in value[1]]
        if all(t is not None for t, _ in ways):
            return set().union(*(t for t, _ in ways)), True
        return None, _join("or", (_needs(t) if t is not None else q for t, q in ways))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, inner = value
        texts, needs = _walk(inner)
        if texts is not None and high != kinds.MAXREPEAT and high <= 8:
            out = set()
            for n in range(low, high + 1):
                out |= {"".join(x) for x in product(texts, repeat=n)} if len(texts) ** n <= SPELLED else {None}
            if None not in out and len(out) <= SPELLED:
                return out, True
        if low == 0:
            return None, True
        return None, _needs(texts) if texts is not None else needs
    return None, True


def trigram_query(pattern: str) -> object:
    """Which trigrams of lower-case text every match of ``pattern`` needs: True, a trigram, or an and/or of queries."""
    texts, needs = _walk(parser.parse(pattern))
    return _needs(texts) if texts is not None else needs


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


# --- index -----------------------------------------------------------------------------------------------------------


def trigram_index(df: DataFrame, trigrams: Sequence[str], *, text_col: str = "text") -> DataFrame:
    """Postings ``trigram, k1, k2``: which texts hold each trigram (its place in ``trigrams``), whatever the case.

    Texts stand for their rows: equal texts share a key. Null texts have no postings.
    """
    low = df.select(*text_key(text_col), F.lower(text_col).alias("low")).where("low is not null")
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select("k1", "k2", F.explode(held).alias("trigram")).sortWithinPartitions("trigram")


def candidates(postings: DataFrame, trigrams: Sequence[str], queries: dict[str, object]) -> DataFrame:
    """Texts that some query finds, with a Boolean column for each: posting lists intersected and united by text."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = range(len(trigrams) // WORD_BITS + 1)
    bit = lambda w: F.when(
        F.floor(F.col("trigram") / WORD_BITS) == w, F.expr(f"shiftleft(1L, cast(trigram % {WORD_BITS} as int))")
    ).otherwise(F.lit(0))
    held = postings.groupBy("k1", "k2").agg(*(F.bit_or(bit(w)).alias(f"w{w}") for w in words))

    def asked(query: object) -> Column:
        if isinstance(query, str):
            i = place[query]
            return F.col(f"w{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0
        parts = [asked(q) for q in sorted(query[1], key=repr)]
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)

    found = held.select("k1", "k2", *(asked(q).alias(k) for k, q in queries.items()))
    return found.where(reduce(lambda a, b: a | b, (F.col(k) for k in queries)))


# --- verification ----------------------------------------------------------------------------------------------------


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans ``(start, place, end)`` of a rule's matches in code points, end exclusive.

    The pieces between matches and the matches cover the text, so their lengths add up to the places. Sums go by
    blocks of about the square root of the number of matches.
    """
    pattern = F.lit(rule.regex)
    parts = F.struct(
        F.transform(F.split(text, rule.regex, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("tested"),
    )

    def sums(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["sizes"])), x["sizes"], lambda g, m: g + m)
        return F.struct(x["gaps"].alias("gaps"), x["sizes"].alias("sizes"), x["tested"].alias("tested"), both.alias("steps"))

    total = lambda steps, start, n: F.aggregate(F.slice(steps, start, n), F.lit(0), lambda a, b: a + b)

    def blocks(x: Column) -> Column:
        n = F.size(x["steps"])
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
        heads = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: total(x["steps"], F.lit(1), b * width)
        )
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                (
                    F.get(heads, F.floor(i / width).cast("int"))
                    + total(x["steps"], F.floor(i / width).cast("int") * width + 1, i % width)
                    + F.get(x["gaps"], i)
                ).alias("start"),
                F.get(x["sizes"], i).alias("size"),
                F.get(x["tested"], i).alias("tested"),
            ),
        )

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    found = let(parts, lambda x: let(sums(x), blocks))
    kept = F.filter(found, lambda s: s["tested"] >= rule.least)
    made = F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), (s["start"] + s["size"]).alias("stop")
        ),
    )
    return F.when(text.rlike(rule.regex), made).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,place:int,stop:int>>")


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``: all secrets of its texts, sorted by start, then by the order of ``rules``.

    Each rule's expression is turned into a query over trigrams. An index of the trigrams that occur in queries
    is built and stored, its posting lists are intersected, and only the texts so found are held against the rule
    itself. Rules that need no trigram are held against every text. Equal texts are searched once and share spans.

    A null text has no spans (an empty list), as has an empty one. All other columns of ``df`` stay, except one named
    ``spans``, which is replaced. Repeated rows stay rows.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = {k: q for k, q in queries.items() if q is not True}
    trigrams = sorted(set().union(*(trigrams_of(q) for q in asked.values()))) if asked else []
    k1, k2, hits, full = (own_name(x) for x in ("k1", "k2", "hits", "full"))
    text = F.col(text_col)
    whole = F.concat(no_spans(), *(spans_of(text, r, i) for i, r in enumerate(rules) if queries[r.kind] is True))
    one, two = text_key(text_col)
    rows = df.drop("spans").withColumns({k1: one, k2: two, full: F.coalesce(whole, no_spans())})
    if not asked:
        return rows.withColumn("spans", F.array_sort(full)).drop(k1, k2, full)
    postings = stored(trigram_index(df, trigrams, text_col=text_col), "trigrams")
    found = stored(candidates(postings, trigrams, asked), "candidates")
    texts = df.select(one, two, text.alias("text")).join(small(found), ["k1", "k2"])
    verified = F.concat(
        *(
            F.when(F.col(r.kind), spans_of(F.col("text"), r, i)).otherwise(no_spans())
            for i, r in enumerate(rules)
            if queries[r.kind] is not True
        )
    )
    hit = (
        texts.select("k1", "k2", verified.alias("hits"))
        .where(F.size("hits") > 0)
        .groupBy("k1", "k2")
        .agg(F.first("hits").alias("hits"))
        .select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("hits").alias(hits))
    )
    joined = rows.join(small(stored(hit, "hits"), 50_000), [k1, k2], "left")
    return joined.withColumn("spans", F.array_sort(F.concat(full, F.coalesce(hits, no_spans())))).drop(k1, k2, full, hits)


def spelled(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["stop"].cast("string"))),
    )


def redacted(text: Column, spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``text`` with ``[kind]`` in place of each span; of spans that overlap, the first names the kind."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(made: Column, s: Column) -> Column:
        between = F.substring(text, made["at"] + 1, s["start"] - made["at"])
        longer = F.concat(made["out"], between, F.lit("["), F.get(names, s["place"]), F.lit("]"))
        return F.struct(
            F.greatest(made["at"], s["stop"]).alias("at"), F.when(s["start"] >= made["at"], longer).otherwise(made["out"]).alias("out")
        )

    whole = F.aggregate(spans, start, step, lambda made: F.concat(made["out"], F.substring(text, made["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; ``n_chars`` is that of the new text."""
    clean = redacted(F.col("text"), F.col("spans"))
    out = scan(docs).withColumn("text", clean).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["place"] == i)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
