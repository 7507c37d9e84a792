"""Secret scans with multipart credential linking, in Spark expressions only.

A credential has parts: an identifier, a secret, an endpoint.  Patterns find
strong parts (assignments, access identifiers, hex keys), always reported, and
weak candidates (user or client names, opaque tokens, addresses), reported only
where complementary parts lie in scope.  The link is an interval join of the
spans of one row on "at most ``scope`` code points apart", taken as a sort-merge
with running maxima: each span learns the nearest end before it and the nearest
start after it for each role, so no pairs are formed.

Positions are code points.  Spark has no expression for the positions of all
matches, so matches are interleaved with the pieces that a split by the same
pattern leaves, and a running sum of lengths gives their starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusterio import cut, own


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(words: str, value: str) -> str:
    return f"({'|'.join(either_case(w) for w in words.split('|'))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


ASSIGN = _named("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
USER = _named("username|user_?id|client_?id|account_?id|login", "[A-Za-z0-9@._-]+")
OPAQUE = "[A-Za-z0-9+/_-]{32,}"
ADDRESS = "[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

#: kind, role, strong, pattern to walk the text with, test of a match.  A run of [0-9a-f] below 24 characters or of
#: AKIA... below 20 cannot hide a longer one, so these two patterns ask for the length at once.
KINDS = (
    ("assign", "secret", True, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", "identifier", True, "AKIA[A-Z0-9]{16,}", lambda m: F.lit(True)),
    ("hex", "secret", True, "[0-9a-f]{24,}", lambda m: F.lit(True)),
    ("user", "identifier", False, USER, lambda m: F.length(F.regexp_extract(m, USER, 2)) >= 3),
    ("opaque", "secret", False, OPAQUE, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ("address", "endpoint", False, ADDRESS, lambda m: F.length(m) >= 10),
)
ROLES = ("identifier", "secret", "endpoint")


def _pieces(text: Column, k: int, pattern: str, test) -> Column:
    """For each match, in order: kind number, length of the text since the last match, its length, whether it counts."""
    none = F.array().cast("array<struct<k:int,gap:int,len:int,ok:boolean>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = lambda m, gap: F.struct(F.lit(k).alias("k"), F.length(gap).alias("gap"), F.length(m).alias("len"), test(m).alias("ok"))
    # both arrays are made once for a text; the piece after the last match has no match and goes
    paired = F.filter(F.zip_with(matches, F.split(text, pattern, -1), piece), lambda p: p["len"].isNotNull())
    return F.when(text.rlike(pattern), paired).otherwise(none)


def scan(docs: DataFrame, *, text: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` without the text, with ``_row`` (unique) and ``_spans``: reported spans by start and kind.

    A span is ``(start, k, kind, end)``, in code points, end exclusive; k is the place of the kind in ``KINDS``.
    Null and empty texts have no spans; repeated rows get the same spans each; columns of those two names are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    pieces = F.concat(*[_pieces(body, k, pattern, test) for k, (_, _, _, pattern, test) in enumerate(KINDS)])
    rows = cut(docs.select(*own(docs, (text, "_row", "_pieces", "_spans")), F.monotonically_increasing_id().alias("_row"), pieces.alias("_pieces")))

    each = rows.where(F.size("_pieces") > 0).select("_row", F.posexplode("_pieces").alias("i", "p")).select("_row", "i", "p.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("_row", "k").orderBy("i"))
    spans = each.select("_row", "k", "ok", (upto - F.col("len")).alias("start"), upto.alias("end")).where("ok").drop("ok")

    kind = F.array(*[F.lit(x[0]) for x in KINDS])
    strong = F.col("k") < sum(x[2] for x in KINDS)
    role = F.element_at(F.array(*[F.lit(x[1]) for x in KINDS]), F.col("k") + 1)
    spans = spans.withColumns({"role": role, "strong": strong})
    ahead = W.partitionBy("_row").orderBy("start", "end", "k").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("_row").orderBy(F.desc("start"), F.desc("end"), F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    is_ = {r: F.col("role") == r for r in ROLES} | {"strong": F.col("strong")}
    seen = {f"{r}_end": F.max(F.when(x, F.col("end"))).over(ahead) for r, x in is_.items()}
    to_come = {f"{r}_start": F.min(F.when(x, F.col("start"))).over(behind) for r, x in is_.items()}
    linked = spans.withColumns(seen).withColumns(to_come)
    near = {r: F.coalesce(F.col("start") - F.col(f"{r}_end") <= scope, F.lit(False)) | F.coalesce(F.col(f"{r}_start") - F.col("end") <= scope, F.lit(False)) for r in ROLES}
    over_strong = F.coalesce(F.col("strong_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_start") < F.col("end"), F.lit(False))
    complete = F.when(is_["identifier"], near["secret"]).when(is_["secret"], near["identifier"] | near["endpoint"]).otherwise(near["identifier"] & near["secret"])
    kept = linked.where(F.col("strong") | (~over_strong & complete))
    lists = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "k", F.element_at(kind, F.col("k") + 1).alias("kind"), "end"))).alias("_spans"))
    none = F.array().cast(lists.schema["_spans"].dataType)
    plain = rows.where(F.size("_pieces") == 0).drop("_pieces").withColumn("_spans", none)  # rows without matches are not shuffled
    told = rows.where(F.size("_pieces") > 0).drop("_pieces").join(lists, "_row", "left").withColumn("_spans", F.coalesce("_spans", none))
    return plain.unionByName(told)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def strong_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["k"] < sum(x[2] for x in KINDS))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[REDACTED]", scope: int = 200) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans become one.  Other rows and columns stay as they are."""
    found = scan(docs.select(F.struct(*own(docs)).alias("doc"), F.col(f"`{text}`").alias("text")), text="text", scope=scope)
    body = F.col("doc").getField(text)
    begin = F.lit(1).cast("long")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substring(body, (a["upto"] + begin).cast("int"), (s["start"] - a["upto"]).cast("int")), F.lit(mark))
        return F.struct(F.when(s["start"] >= a["upto"], more).otherwise(a["out"]).alias("out"), F.greatest(a["upto"], s["end"]).alias("upto"))

    done = F.aggregate("_spans", start, step)
    rest = F.concat(done["out"], F.substring(body, (done["upto"] + begin).cast("int"), F.length(body)))
    blotted = F.when(F.size("_spans") > 0, rest).otherwise(body)
    return found.select(*[(blotted if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
