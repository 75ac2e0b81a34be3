"""Secret scans: base patterns, and weak parts of credentials linked to what completes them.

1. Each text is scanned once for each kind. Splitting by a pattern gives the lengths between its
   matches, extraction their lengths; running sums of both, by a window over the matches of a
   document, are positions in code points.
2. Base kinds (``assign``, ``access``, ``hex``) count by themselves. Weak kinds are parts of a
   credential: an ``identifier`` (a user or key name that is given), a ``key`` (a long mixed run of
   base-64 letters), an ``endpoint`` (a URL with a known scheme, or an IP address).
3. A weak part has a scope: so many characters to both sides, within its paragraph. Scopes and parts are
   intervals; they are joined by the bins that both reach into, so rows of one bin meet only, and a
   bin holds no more parts than characters. An identifier is reported if a secret is in its scope, a
   key if an identifier or an endpoint is, an endpoint if an identifier and a secret are.

All of it is DataFrame functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.tasks import column
from gleaner.session import materialise

#: Characters to both sides of a part that are its scope, and characters in a bin.
REACH, BIN = 200, 512


class Kind(NamedTuple):
    """A pattern; what its ``group`` must be long and look like for a match to count."""

    name: str
    role: str
    base: bool
    pattern: str
    group: int = 0
    least: int = 1
    looks: tuple[str, ...] = ()


GIVEN = r"""["']?\x20*[:=]\x20*["']?"""

#: Kinds in the order in which spans with the same start are listed. A run of hex digits or one that
#: begins with AKIA ends where its letters end, so lengths can be in the pattern; an assignment that is too
#: short still takes its letters from a later one.
KINDS = (
    Kind("assign", "secret", True, r"(?i:(password|passwd|secret|token|api_?key))" + GIVEN + r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", "identifier", True, r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", "secret", True, r"[0-9a-f]{24,}"),
    Kind("identifier", "identifier", False, r"(?i:user(?:name)?|login|account|client_?id|key_?id)" + GIVEN + r"([A-Za-z0-9_.@+-]+)", 1, 3),
    Kind("key", "secret", False, r"[A-Za-z0-9+/_=-]{20,}", looks=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", "endpoint", False, r"""(?:(?:https?|wss?|s?ftp|ssh|s3|jdbc:[a-z0-9]{1,16}|mongodb|postgres(?:ql)?|mysql|redis|amqps?)://[^\x00-\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)"""),
)
BREAK = Kind("break", "", False, r"\n[\x20\t\r]*\n")


def _scan(text: Column, kind: Kind, number: int) -> Column:
    """``kind, gaps, sizes, counts`` of all matches, null where there is none."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def counts(m: Column) -> Column:
        out = F.length(m) >= kind.least
        for pattern in kind.looks:
            out = out & m.rlike(pattern)
        return out

    return F.when(
        text.rlike(kind.pattern),
        F.struct(
            F.lit(number).alias("kind"),
            F.transform(F.split(text, kind.pattern), F.length).alias("gaps"),
            F.transform(whole, F.length).alias("sizes"),
            F.transform(found, counts).alias("counts"),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, scans``: the matches of each row, which ``tag`` numbers; stored."""
    text = F.coalesce(column(text_col), F.lit(""))
    scans = F.filter(F.array(*[_scan(text, kind, k) for k, kind in enumerate((*KINDS, BREAK))]), lambda x: x.isNotNull())
    return materialise(docs.select(column(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), scans.alias("scans")), "scans")


def located(scanned: DataFrame) -> DataFrame:
    """``tag, kind, start, end``: the matches that count, with positions in code points."""
    each = scanned.select("tag", F.explode("scans").alias("s"))
    zipped = F.arrays_zip(F.slice("s.gaps", F.lit(1), F.size("s.sizes")).alias("gap"), F.col("s.sizes").alias("size"), F.col("s.counts").alias("counts"))
    rows = each.select("tag", "s.kind", F.posexplode(zipped).alias("nth", "m")).select("tag", "kind", "nth", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("tag", "kind").orderBy("nth"))
    return rows.withColumn("end", end).where("counts").select("tag", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _is(test) -> Column:
    """Whether the column ``kind`` is one of those that pass."""
    return F.col("kind").isin(*[k for k, kind in enumerate(KINDS) if test(kind)])


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)))


def link(parts: DataFrame, reach: int = REACH, width: int = BIN) -> DataFrame:
    """``tag, kind, start, end``: weak parts in whose scope is what completes them.

    ``parts`` has breaks between paragraphs too. A weak part that overlaps a base one says nothing
    new, and a part doesn't complete another that it overlaps.
    """
    here = Window.partitionBy("tag").orderBy("start", "end")
    is_break = F.col("kind") == len(KINDS)
    opens = F.max(F.when(is_break, F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    closes = F.min(F.when(is_break, F.col("start"))).over(here.rowsBetween(1, Window.unboundedFollowing))
    known = materialise(parts.withColumn("opens", opens).withColumn("closes", closes).where(~is_break), "parts")
    weak = known.where(_is(lambda k: not k.base)).select(
        "tag", F.col("kind").alias("weak_kind"), F.col("start").alias("weak_start"), F.col("end").alias("weak_end"),
        F.greatest(F.col("start") - reach, F.coalesce("opens", F.lit(0)), F.lit(0)).alias("low"),
        F.least(F.col("end") + reach, F.coalesce("closes", F.col("end") + reach)).alias("high"),
    )
    weak = weak.select("*", _bins(F.col("low"), F.col("high"), width).alias("bin"))
    near = known.select("tag", "kind", "start", "end", _bins(F.col("start"), F.col("end"), width).alias("bin"))
    meets = (F.col("start") < F.col("high")) & (F.col("end") > F.col("low"))
    overlaps = (F.col("start") < F.col("weak_end")) & (F.col("end") > F.col("weak_start"))
    inside = (F.col("start") >= F.col("low")) & (F.col("end") <= F.col("high")) & ~overlaps

    def any_of(test) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    def has(role: str) -> Column:
        return any_of(inside & _is(lambda k: k.role == role))

    found = weak.join(near, (weak["tag"] == near["tag"]) & (weak["bin"] == near["bin"]) & meets).groupBy(weak["tag"], "weak_kind", "weak_start", "weak_end")
    found = found.agg(any_of(overlaps & _is(lambda k: k.base)).alias("known"), *[has(role).alias(role) for role in ("identifier", "secret", "endpoint")])
    of = {kind.name: F.col("weak_kind") == k for k, kind in enumerate(KINDS)}
    complete = (of["identifier"] & F.col("secret")) | (of["key"] & (F.col("identifier") | F.col("endpoint"))) | (of["endpoint"] & F.col("identifier") & F.col("secret"))
    return found.where(~F.col("known") & complete).select("tag", F.col("weak_kind").alias("kind"), F.col("weak_start").alias("start"), F.col("weak_end").alias("end"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """All base spans and linked weak parts of every text.

    Returns ``doc_id`` and ``spans``, an array of ``start, kind, end`` (code points, end exclusive; ``kind``
    is the place in ``KINDS``) in the order of start, then kind. Null and empty texts have none. Repeated
    rows and rows that share an id are scanned each by itself; null ids stay null. Other columns
    are not read, whatever their names. An empty table gives no rows. Lengths of texts have no bound but
    that of a row: bins, not whole texts, are joined.
    """
    scanned = scan(docs, id_col, text_col)
    parts = materialise(located(scanned), "located")
    spans = parts.where(_is(lambda k: k.base)).unionByName(link(parts, reach))
    listed = spans.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("doc_id", "tag").join(listed, "tag", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of :func:`find_secrets`."""
    base = F.filter("spans", lambda x: x["kind"] < sum(k.base for k in KINDS))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == number)).cast("long")

    counts = [count(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS) if kind.base]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
