"""Secret scans by corpus-wide ownership frequency.

Patterns find candidates. Hashes of their values are counted over the distinct repositories
and owners that hold them: a value that many owners hold is a copied example, one that a single
owner holds in few repositories looks live.

Everything is made of SQL functions. ``split`` gives the texts between the matches of a
pattern and ``regexp_extract_all`` the matches; sums of their lengths along a text give the positions,
so the work grows with the hits of a text and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs shorter than 32 are no matches, and runs do not overlap
# Values of other forms: long tokens that hold a digit, a lower and an upper case letter.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
OWNED = 3
MAX_OWNERS = 1
MAX_REPOSITORIES = 3

_HIT = "array<struct<kind:int,place:int,gap:bigint,size:bigint,value:bigint,keep:boolean>>"


def _hits(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Matches of a pattern in order: kind, place, length of the text since the match before, length,
    hash of the match or of its ``group``, and what ``keep`` says of (match, group)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    hit = lambda x, place: F.struct(
        F.lit(kind).alias("kind"), place.alias("place"), F.length(x["gap"]).cast("bigint").alias("gap"),
        F.length(x["match"]).cast("bigint").alias("size"), F.xxhash64(x["value"]).alias("value"),
        keep(x["match"], x["value"]).alias("keep"),
    )
    hits = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value")), hit)
    # Texts without a match are read once.
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(_HIT))


def text_hits(text: Column) -> Column:
    """Matches of the base kinds and of tokens of other forms."""
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    return F.concat(
        _hits(text, ASSIGN, 0, lambda match, value: F.length(value) >= 8, group=2),
        _hits(text, ACCESS, 1, lambda match, value: F.length(match) >= 16),
        _hits(text, HEX, 2, lambda match, value: F.lit(True)),
        _hits(text, TOKEN, OWNED, lambda match, value: mixed(match)),
    )


def kept_spans(rows: DataFrame) -> DataFrame:
    """row, owner, repository, kind, start, stop and value: hits by their places in the text.

    Base spans that pass, and tokens that pass and overlap none of these. Of ``rows`` the columns row, owner,
    repository and hits are read.
    """
    hits = rows.where(F.size("hits") > 0).select("row", "owner", "repository", F.explode("hits").alias("h"))
    hits = hits.select("row", "owner", "repository", "h.*")
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(along)
    spans = hits.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("keep")
    base = F.col("kind") != OWNED
    # A token overlaps a base span that begins no later and ends behind its start, or one that
    # begins later and before its end.
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns(
        {
            "before": F.coalesce(F.max(F.when(base, F.col("stop"))).over(earlier), F.lit(-1)),
            "after": F.min(F.when(base, F.col("start"))).over(later),
        }
    )
    free = (F.col("before") <= F.col("start")) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))
    return spans.where(base | free).select("row", "owner", "repository", "kind", "start", "stop", "value")


def _listed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_owners and n_repositories of rows of (value, owner, repository).

    Distinct pairs first, so a value that a third of all rows hold is spread by
    owner and repository before it is counted.
    """
    pairs = candidates.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("value").agg(
        F.count("*").cast("long").alias("n_owners"), F.sum("n").cast("long").alias("n_repositories")
    )


def scan_documents(
    docs: DataFrame, owner: str = "source", repository: str | None = None,
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Secrets of every row of ``docs``.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned (spans added for
    tokens that look live), n_live and n_copied (base spans by the owners of their value).
    A table without a ``repository`` column has one repository for each distinct text, so copies of a
    document count once for an owner, whatever their ids. A null text is an empty one; a null owner or repository counts as one of its own. Repeated rows are
    scanned each and count once. Empty input gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # The row number is taken before the table is written, and read from it ever after.
    rows = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col(owner).cast("string").alias("owner"),
            (F.xxhash64(text) if repository is None else F.col(repository).cast("string")).alias("repository"),
            text_hits(text).alias("hits"),
        ),
        "candidates",
    )
    candidates = kept_spans(rows)
    verdicts = ownership(candidates)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    owned = F.col("kind") == OWNED
    span = F.struct("start", "kind", "stop")
    judged = (
        candidates.join(verdicts, "value")
        .groupBy("row")
        .agg(
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS[:OWNED])],
            F.array_sort(F.collect_list(F.when(~owned, span))).alias("base"),
            F.array_sort(F.collect_list(F.when(~owned | live, span))).alias("spans"),
            F.count(F.when(owned & live, 1)).alias("n_owned"),
            F.count(F.when(~owned & live, 1)).alias("n_live"),
            F.count(F.when(~owned & ~live, 1)).alias("n_copied"),
        )
    )
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    listed = lambda name: F.coalesce(_listed(F.col(name)), F.lit(""))
    return rows.select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id",
        *map(number, ("n_assign", "n_access", "n_hex")),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        *map(number, ("n_owned", "n_live", "n_copied")),
    )
