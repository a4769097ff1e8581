"""Multipart credentials, in DataFrame functions alone: parts are found by pattern and linked by an interval join in scopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import unused

#: The base kinds, in the order in which ties of start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Weak parts: reported only next to their complements.
IDENTIFIER = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|amqp|redis|s3)://[A-Za-z0-9._:@/?&=%+~#-]+"
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: A scope reaches this many code points before and after a part.
SCOPE = 200
FAN = 64  # values of an array that one step of a running total goes through
LEVELS = 3  # such steps above one another; more than FAN^LEVELS values make the last one longer
CUT = 1024  # code points of the smallest pieces that a redacted text is cut into
_PART = "array<struct<start:bigint,kind:int,stop:bigint>>"
_NONE = -(1 << 40)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """An array as arrays of FAN values."""
    count = F.ceil(F.size(values) / FAN).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(values, b * FAN + 1, FAN))


def _totals(values: Column, zero: Column, join: Callable[[Column, Column], Column], kind: str, levels: int = LEVELS) -> Column:
    """For each value, what all values before it come to under `join`. Time grows with the number of values, not its square.

    Arrays can only be extended by copying them, so this goes by blocks, whose own totals come from the same step above."""

    def within(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, state, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return within(values, zero)

    def above(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        return F.flatten(F.zip_with(blocks, _totals(sums, zero, join, kind, levels - 1), within))

    return _let(values, lambda v: _let(_blocks(v), above))


def _find(text: Column, kind: int, pattern: str, least: int, group: int = 0) -> Column:
    """Spans of a pattern, leftmost and without overlaps; those under `least` code points (of the group) are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    length = lambda x: F.length(x).cast("bigint")
    sizes = F.arrays_zip(F.transform(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), length).alias("g"), F.transform(whole, length).alias("h"), F.transform(part, length).alias("p"))

    def spans(sizes: Column) -> Column:
        before = _totals(F.transform(sizes, lambda x: x["g"] + x["h"]), F.lit(0).cast("bigint"), lambda a, b: a + b, "bigint")
        span = lambda x, at: F.struct((at + x["g"]).alias("start"), F.lit(kind).alias("kind"), (at + x["g"] + x["h"]).alias("stop"), x["p"].alias("p"))
        kept = F.filter(F.zip_with(sizes, before, span), lambda x: x["p"] >= least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))

    return F.when(text.rlike(pattern), _let(sizes, spans)).otherwise(F.array().cast(_PART))


def linked(base: Column, weak: Column) -> Column:
    """Strong parts, and weak ones whose complements lie in their scope, in order.

    An interval join by one merged pass over positions: parts enter where they start, a weak part asks where its scope
    ends, and the furthest end of any identifier or secret that has entered by then tells whether one reaches its scope.
    Complements: an identifier wants a secret (assign, hex, key); a key wants an identifier (access, identifier);
    an endpoint wants an identifier and a secret.
    """
    end = lambda x, *kinds: F.when(x["kind"].isin(*kinds), x["stop"]).otherwise(F.lit(_NONE).cast("bigint"))
    far = lambda ids, secrets: F.struct(ids.alias("ids"), secrets.alias("secrets"))
    none = F.lit(_NONE).cast("bigint")
    event = lambda at, asks, x, reach: F.struct(at.alias("at"), F.lit(asks).alias("asks"), x.alias("part"), reach.alias("reach"))
    enters = F.transform(F.concat(base, weak), lambda x: event(x["start"], 0, x, far(end(x, 1, 3), end(x, 0, 2, 4))))
    asks = F.transform(weak, lambda x: event(x["stop"] + SCOPE, 1, x, far(none, none)))

    def answered(events: Column) -> Column:
        further = lambda a, b: far(F.greatest(a["ids"], b["ids"]), F.greatest(a["secrets"], b["secrets"]))
        reach = _totals(F.transform(events, lambda e: e["reach"]), far(none, none), further, "struct<ids:bigint,secrets:bigint>")
        both = F.zip_with(events, reach, lambda e, r: F.struct(e["asks"].alias("asks"), e["part"].alias("part"), r.alias("reach")))

        def holds(x: Column) -> Column:
            scope, kind = x["part"]["start"] - SCOPE, x["part"]["kind"]
            ids, secrets = x["reach"]["ids"] >= scope, x["reach"]["secrets"] >= scope
            return (x["asks"] == 1) & F.when(kind == 3, secrets).when(kind == 4, ids).otherwise(ids & secrets)

        return F.transform(F.filter(both, holds), lambda x: x["part"])

    return F.array_sort(F.concat(base, _let(F.array_sort(F.concat(enters, asks)), answered)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _spans(text: Column) -> tuple[Column, Column]:
    """Base and weak parts of a text that is not null."""
    found = [
        _find(text, 0, ASSIGN, LEAST["assign"], 1),
        _find(text, 1, ACCESS, LEAST["access"]),
        _find(text, 2, r"[0-9a-f]{24,}", LEAST["hex"]),
    ]
    any_id = text.rlike(rf"AKIA[A-Z0-9]{{16}}|{IDENTIFIER}")
    weak = F.when(any_id, F.concat(_find(text, 3, IDENTIFIER, 3), _find(text, 4, KEY, 40), _find(text, 5, ENDPOINT, 8))).otherwise(F.array().cast(_PART))
    return F.array_sort(F.concat(*found)), weak


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds arrays of (start, kind, stop) in code points, in order of start and kind: base, and spans with weak parts.

    No shuffle: all of a document's parts are in its row, and the work grows with its length. Null or empty text: no
    spans. Very long texts, ties and repeated rows: each row for itself, whole. Empty tables: empty results. Columns that
    the table has stay as they are; a new one whose name is taken has underscores behind it.
    """
    base = unused(docs, base)
    out, weak = docs, unused(docs, "_weak")
    found, more = _spans(F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(base, found).withColumn(weak, more)
    spans = unused(out, spans)
    return out.withColumn(spans, F.when(F.size(weak) == 0, F.col(base)).otherwise(linked(F.col(base), F.col(weak)))).drop(weak)


def _apart(spans: Column) -> Column:
    """Spans in order without overlaps: (start, stop, head), head where a mark goes."""
    before = _totals(F.transform(spans, lambda x: x["stop"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b), "bigint")
    both = F.zip_with(spans, before, lambda x, b: F.struct(F.greatest(x["start"], b).alias("start"), F.greatest(x["stop"], b).alias("stop"), (x["start"] >= b).alias("head")))
    return F.filter(both, lambda x: x["head"] | (x["stop"] > x["start"]))


def _cut(text: Column, spans: Column, mark: str, levels: int = LEVELS) -> Column:
    """The text without the spans, a mark for each head. Level by level it is cut into FAN pieces, each with its own spans."""
    if not levels:
        state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
        piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        step = lambda acc, x: F.struct(x["stop"].alias("at"), F.concat(acc["out"], piece(acc["at"], x["start"]), F.when(x["head"], F.lit(mark)).otherwise("")).alias("out"))
        return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    size = CUT * FAN ** (levels - 1)

    def one(x: Column, i: Column, spans: Column) -> Column:
        at = i.cast("bigint") * size
        own = F.filter(spans, lambda s: (s["stop"] > at) & (s["start"] < at + size) | s["head"] & (s["start"] >= at) & (s["start"] < at + size))
        own = F.transform(own, lambda s: F.struct(F.greatest(s["start"] - at, F.lit(0)).alias("start"), F.least(s["stop"] - at, F.lit(size)).alias("stop"), (s["head"] & (s["start"] >= at)).alias("head")))
        return _let(F.struct(x.alias("x"), own.alias("own")), lambda v: F.when(F.size(v["own"]) > 0, _cut(v["x"], v["own"], mark, levels - 1)).otherwise(v["x"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    whole = _let(F.struct(pieces.alias("p"), spans.alias("s")), lambda v: F.array_join(F.transform(v["p"], lambda x, i: one(x, i, v["s"])), ""))
    return F.when(F.length(text) > size, whole).otherwise(_cut(text, spans, mark, levels - 1))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Documents with every reported span replaced by `mark`; overlapping spans are one. Same columns.

    n_chars follows where a text changes, if the table has it. Null or empty text: as it is. Ties, repeated rows and very
    long texts: each row for itself, whole. Empty tables: empty results. Columns of any other names stay as they are.
    """
    found = scan(docs, text, unused(docs, "_base"), unused(docs, "_spans"))
    spans = F.col(found.columns[-1])
    some = F.size(spans) > 0
    clean = F.when(some, _let(F.struct(F.col(text).alias("t"), _apart(spans).alias("s")), lambda v: _cut(v["t"], v["s"], mark))).otherwise(F.col(text))
    new = unused(found, "_new")
    out = found.withColumn(new, clean)
    changed = {text: F.col(new)} | ({"n_chars": F.when(some, F.length(new).cast("bigint")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def secret_table(docs: DataFrame) -> DataFrame:
    """The digest of op2. Other columns of the table are not read, whatever their names; for the rest see `scan`."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
