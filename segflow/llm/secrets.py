"""Finding secrets in documents, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.llm.shared import cut

#: Code points between parts of one credential.
SCOPE = 200


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns. A quote, blanks, a colon or an equals sign, blanks, a quote.
GIVES = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + GIVES + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: they count only beside a part that completes them.
IDENTIFIER = "(?:" + "|".join(map(either_case, ("username", "user", "login", "account", "client_?id", "key_?id"))) + ")" + GIVES + "[A-Za-z0-9._@-]{3,}"
BLOB = "[A-Za-z0-9/+_=-]{32,}"
ENDPOINT = r"""(?:https?://[^\x00-\x20"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?)"""
#: Kinds in their order, with the part of a credential that each is.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "blob": "secret", "endpoint": "endpoint"}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "blob": BLOB, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points.

    The text between matches and the matches alternate, so their lengths add up to places.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        first = done["at"] + x["g"]
        span = F.struct(first.alias("start"), (first + x["m"]).alias("end"), x["v"].alias("value"))
        return F.struct((first + x["m"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step)["spans"])


def candidates(text: Column) -> dict[str, Column]:
    """The spans of each kind, strong and weak, as arrays of (start, end)."""
    valid = {
        "assign": lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6,
        "blob": lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"),
    }
    def of_kind(kind: str) -> Column:
        spans, number = matches(text, PATTERNS[kind]), list(KINDS).index(kind)
        spans = F.filter(spans, lambda s: valid[kind](s["value"])) if kind in valid else spans
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    return {kind: of_kind(kind) for kind in PATTERNS}


def count_kind(spans: str, kind: str) -> Column:
    """How many spans of an array column are of the kind."""
    number = list(KINDS).index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def written(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def completed(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, span): weak spans with a complementary part at most ``scope`` code points away.

    A blob completes an identifier, and is completed by it; an endpoint is completed by strong secrets alone.
    An interval join: spans are cut into bins of ``scope``, secrets widened by
    it, and joined with identifiers and endpoints of the same text by bin. A bin
    holds few spans, so a text full of secrets makes few pairs.
    """
    span = F.col("span")
    part = F.element_at(F.array(*[F.lit(p) for p in KINDS.values()]), span["kind"] + 1)
    each = parts.withColumn("part", part)
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    secrets = each.where("part = 'secret'").select("key", span.alias("secret"), bins(span["start"] - scope, span["end"] + scope).alias("bin"))
    others = each.where("part <> 'secret'").select("key", span.alias("other"), bins(span["start"], span["end"]).alias("bin"))
    pairs = secrets.join(others, ["key", "bin"]).where((F.col("other.kind") != 5) | (F.col("secret.kind") < len(BASE))).where((F.col("other.start") <= F.col("secret.end") + scope) & (F.col("other.end") >= F.col("secret.start") - scope))
    both = pairs.select("key", F.explode(F.array("secret", "other")).alias("span"))
    return both.where(F.col("span.kind") >= len(BASE)).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Secrets of every whole text.

    Strong kinds (assignments, access identifiers, long hex runs) are always
    reported. Weak ones only complete others: a mixed-case blob beside an
    identifier, an identifier beside a secret, an endpoint beside a strong
    secret, within ``scope`` code points of the same text.

    Adds ``base`` and ``spans`` (arrays of (start, kind number, end), sorted;
    kinds number as in ``KINDS``), which replace input columns of these names,
    and drops the text. Null and empty texts have none; null ids and repeated
    rows pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = candidates(text)
    kind = "array<struct<start: int, kind: int, end: int>>"
    empty = F.expr(f"cast(array() as {kind})")
    listed = docs.drop("base", "spans").withColumns({f"__{k}": F.coalesce(c, empty) for k, c in found.items()})
    listed = listed.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col))).drop(text_col)
    listed = cut(listed.withColumn("base", F.array_sort(F.concat(*[F.col(f"__{k}") for k in BASE]))).withColumn("__weak", F.concat(*[F.col(f"__{k}") for k in KINDS if k not in BASE])).drop(*[f"__{k}" for k in KINDS]))
    parts = listed.where(F.size("__weak") > 0).select(F.col("__key").alias("key"), F.explode(F.concat("base", "__weak")).alias("span")).distinct()
    added = completed(parts, scope).groupBy(F.col("key").alias("__key")).agg(F.collect_set("span").alias("__added"))
    joined = listed.join(added, "__key", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("__added", empty)))).drop("__key", "__weak", "__added")
