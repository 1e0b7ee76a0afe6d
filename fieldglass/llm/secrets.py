"""Secret scans: pattern matches with code-point spans, and weak parts linked within a scope.

Only DataFrame functions are used, and everything about a text is worked out
in its own row, so nothing is shuffled.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they match.
Weak kinds are reported only when complementary parts lie within ``SCOPE``
code points of each other:

* ``ident``: a user, client or key name given a value,
* ``endpoint``: a URL,
* ``opaque``: a run of 20 or more letters, digits and ``+/_-`` with a
  capital, a small letter and a digit,

where base matches count as secrets (``assign``, ``hex``) or as identifiers
(``access``).  An opaque run needs an identifier or an endpoint in scope; an
identifier or endpoint needs a secret or an opaque run in scope.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import free_name

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
#: A greedy run of 32 or more is the same match as a run that is dropped when shorter.
HEX = r"[0-9a-f]{32,}"

IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: An opaque run has one of each.
OPAQUE_HAS = ("[A-Z]", "[a-z]", "[0-9]")
#: Code points between two parts that belong together.
SCOPE = 200

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "ident", "endpoint", "opaque")
_BASE = (0, 1, 2)
#: The side of secrets; the others are what a secret belongs to.
_SECRET = (0, 2, 5)
_SPAN = "struct<start:int,rank:int,end:int>"
#: Steps of a scan that share one array under construction.
_CHUNK = 64
_FAR = 1 << 30


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) of each item in turn, where ``state`` is what ``step`` made of the items before.

    Arrays grow ``_CHUNK`` items at a time, so a long row costs no copies of
    all that was found before.
    """

    def inner(state: Column, chunk: Column) -> Column:
        begin = F.struct(state.alias("state"), _empty(kind).alias("out"))
        return F.aggregate(chunk, begin, lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))

    def cut(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(held, i * _CHUNK + 1, F.lit(_CHUNK)))

    begin = F.struct(zero.alias("state"), _empty(f"array<{kind}>").alias("out"))
    merge = lambda acc, chunk: _let(inner(acc["state"], chunk), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    return F.aggregate(_let(items, cut), begin, merge, lambda acc: F.flatten(acc["out"]))


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0, has: tuple[str, ...] = ()) -> Column:
    """Spans of the leftmost non-overlapping matches.

    Those whose ``group`` is shorter than ``least``, or lacks one of ``has``,
    are dropped afterwards.

    Matches and the pieces between them alternate, so running lengths are the
    positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)

    def keep(m: Column) -> Column:
        return reduce(lambda a, p: a & m.rlike(p), has, F.length(m) >= least)

    steps = F.zip_with(
        F.transform(F.slice(pieces, 1, F.size(whole)), F.length),
        F.zip_with(F.transform(whole, F.length), F.transform(judged, keep), lambda n, m: F.struct(n.alias("n"), m.alias("keep"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["keep"].alias("keep")),
    )
    end = lambda at, x: at + x["gap"] + x["n"]
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.when(x["keep"], F.lit(KINDS.index(kind))).alias("rank"), end(at, x).alias("end"))
    found = F.filter(_scan(steps, F.lit(0), end, span, _SPAN), lambda x: x["rank"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(_empty(_SPAN))


def _with_neighbours(spans: Column, marked: Callable[[Column], Column]) -> Column:
    """Interval join in a row, for spans in order: struct(span, before, after), where ``before`` is the largest end of the marked spans ahead of it, and ``after`` the least start of those behind it."""
    behind = _scan(spans, F.lit(-_FAR), lambda m, x: F.when(marked(x), F.greatest(m, x["end"])).otherwise(m), lambda m, x: m, "int")
    ahead = F.reverse(_scan(F.reverse(spans), F.lit(_FAR), lambda m, x: F.when(marked(x), F.least(m, x["start"])).otherwise(m), lambda m, x: m, "int"))
    return F.zip_with(spans, F.arrays_zip(behind.alias("before"), ahead.alias("after")), lambda x, n: F.struct(x.alias("span"), n["before"].alias("before"), n["after"].alias("after")))


def _linked(spans: Column, scope: int) -> Column:
    """The spans (base ones, and weak ones of which a complementary part is at most ``scope`` code points away), without opaque runs that overlap a base span."""
    base, secret = (lambda ranks: lambda x: x["rank"].isin(*ranks))(_BASE), (lambda ranks: lambda x: x["rank"].isin(*ranks))(_SECRET)
    overlaps = lambda n: (n["before"] > n["span"]["start"]) | (n["after"] < n["span"]["end"])
    opaque = KINDS.index("opaque")
    fresh = lambda held: F.transform(F.filter(_with_neighbours(held, base), lambda n: (n["span"]["rank"] != opaque) | ~overlaps(n)), lambda n: n["span"])
    near = lambda n: (n["before"] + scope >= n["span"]["start"]) | (n["after"] <= n["span"]["end"] + scope)

    def link(held: Column) -> Column:
        others, secrets = _with_neighbours(held, lambda x: ~secret(x)), _with_neighbours(held, secret)
        both = F.zip_with(others, secrets, lambda o, s: F.struct(o["span"].alias("span"), (base(o["span"]) | F.when(secret(o["span"]), near(o)).otherwise(near(s))).alias("keep")))
        return F.transform(F.filter(both, lambda x: x["keep"]), lambda x: x["span"])

    return _let(fresh(spans), link)


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", scope: int = SCOPE) -> DataFrame:
    """Add array ``out`` of struct(kind, start, end), sorted by start and kind; ends are exclusive, in code points.

    A null text counts as empty and has no spans.  An existing column ``out``
    is replaced.  Rows are kept as they are, repeated ones too.  Matches of
    different kinds may overlap.  An opaque run that overlaps a base match is
    not reported again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = {
        "assign": _spans(body, ASSIGN, "assign", 2, ASSIGN_LEAST),
        "access": _spans(body, ACCESS, "access", 0, ACCESS_LEAST),
        "hex": _spans(body, HEX, "hex"),
        "ident": _spans(body, IDENT, "ident"),
        "endpoint": _spans(body, ENDPOINT, "endpoint"),
        "opaque": _spans(body, OPAQUE, "opaque", has=OPAQUE_HAS),
    }
    kept = docs.drop(out)
    found = free_name(kept, "spans")
    every = kept.withColumn(found, F.array_sort(F.concat(*parts.values())))
    weak = F.exists(F.col(found), lambda x: x["rank"] > max(_BASE))
    spans = F.when(weak, _linked(F.col(found), scope)).otherwise(F.col(found))
    label = F.array(*[F.lit(k) for k in KINDS])
    shaped = F.transform(spans, lambda s: F.struct(F.element_at(label, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return every.withColumn(out, shaped).drop(found)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one replacement, of the first kind."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col(spans), begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text)))
