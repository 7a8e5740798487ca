"""Secret scans by multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.llm.common import materialise, row_key

# Fixed patterns of the base kinds. Only the runs that can pass the length rule are searched for
# in hex and access: a maximal run of N or more characters is the same match either way.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak parts, reported only beside a complementary part.
ACCESS_ID = r"""(?i:access_key_id|client_id|account_id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
SECRET_PART = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[A-Za-z0-9][A-Za-z0-9._:/-]{3,}"""

PATTERNS = (
    ("assign", ASSIGN), ("access", ACCESS), ("hex", HEX),
    ("access_id", ACCESS_ID), ("secret_part", SECRET_PART), ("endpoint", ENDPOINT),
)
RANK = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
SCOPE = 240


def _hits(kind: str, pattern: str, text: Column) -> Column:
    """Matches of one kind as (kind, i, gap, len, ok): gap is the text since the match before."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = {
        "assign": lambda h: F.length(F.regexp_replace(h, ASSIGN_HEAD, "")) >= 12,
        "secret_part": lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]"),
    }.get(kind, lambda h: F.lit(True))
    rows = F.zip_with(
        found, F.slice(pieces, F.lit(1), F.size(found)),
        lambda h, g: F.struct(F.lit(RANK[kind]).alias("kind"), F.length(g).alias("gap"), F.length(h).alias("len"), ok(h).alias("ok")),
    )
    indexed = F.transform(rows, lambda r, i: F.struct(r["kind"].alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["len"].alias("len"), r["ok"].alias("ok")))
    return F.when(text.rlike(pattern), indexed)


def candidate_spans(docs: DataFrame) -> DataFrame:
    """Spans of every kind as (rk, kind, start, end), code points, end exclusive.

    The lengths of the text between the matches and of the matches are summed along each
    document and kind, so the cost follows the number of matches, not its square.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    every = F.concat(*[F.coalesce(_hits(k, p, text), empty) for k, p in PATTERNS])
    rows = (
        docs.select(row_key(F.col("doc_id"), text).alias("rk"), F.explode(every).alias("h"))
        .select("rk", "h.*").distinct()
    )
    along = W.partitionBy("rk", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(along)
    return rows.withColumn("end", end).where("ok").select("rk", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _beside(weak: DataFrame, part: DataFrame, scope: int) -> DataFrame:
    """Interval join: weak spans that have a span of `part` starting within `scope` code points.

    Both sides meet in scope-wide cells of their document; a part stands in its own cell and in
    both neighbours, so equal cells hold every pair in reach, and the join stays an equi-join.
    """
    cell = F.floor(F.col("start") / scope)
    there = part.select(
        F.col("rk").alias("p_rk"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("p_cell"),
    )
    near = (F.abs(F.col("p_start") - F.col("start")) <= scope) & ((F.col("p_end") <= F.col("start")) | (F.col("p_start") >= F.col("end")))
    return weak.withColumn("cell", cell).join(there, (F.col("rk") == F.col("p_rk")) & (F.col("cell") == F.col("p_cell")) & near, "left_semi").drop("cell")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and the weak parts that stand beside their complement.

    An access identifier needs a secret, a lone secret needs an identifier or an endpoint, an
    endpoint needs both. Overlapping spans never complement each other.
    """
    of = lambda *kinds: spans.where(F.col("kind").isin([RANK[k] for k in kinds]))
    ids, secrets = of("access", "access_id"), of("assign", "secret_part")
    linked = [
        _beside(of("access_id"), secrets, scope),
        _beside(of("secret_part"), ids.unionByName(of("endpoint")), scope),
        _beside(_beside(of("endpoint"), secrets, scope), ids, scope),
    ]
    return reduce(DataFrame.unionByName, linked, of("assign", "access", "hex"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, base_sha256, spans and the span list.

    Base kinds are always reported: assign, access, hex. The method adds access_id, secret_part
    and endpoint spans where complementary parts co-occur within `scope` code points.
    Null text is empty text: zero counts and the hash of the empty string. Rows that share a
    doc_id are scanned apart; a null doc_id keeps its row. Extra columns are ignored.
    """
    spans = materialise(candidate_spans(docs), "spans")
    name = F.element_at(F.array(*[F.lit(k) for k, _ in PATTERNS]), F.col("kind") + 1)
    item = F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("label"))
    per_doc = (
        link_parts(spans, scope).groupBy("rk")
        .agg(
            *[F.count(F.when(F.col("kind") == RANK[k], 1)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
            F.sort_array(F.collect_list(item)).alias("found"),
        )
    )
    labels = lambda a: F.array_join(F.transform(a, lambda s: s["label"]), ",")
    base = labels(F.filter("found", lambda s: s["kind"] <= RANK["hex"]))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("rk"))
    return keyed.join(per_doc, "rk", "left").select(
        "doc_id", "rk",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.coalesce(base, F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(labels(F.col("found")), F.lit("")).alias("spans"),
        "found",
    )


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by `mark`; columns as before, n_chars counted anew."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = scan_secrets(docs, scope).where(F.size("found") > 0).select(F.col("rk").alias("__rk"), F.col("found").alias("__spans")).dropDuplicates(["__rk"])
    spans = F.col("__spans")
    # Text from the furthest end before each span up to its start; covered spans add nothing.
    ends = F.transform(spans, lambda s: s["end"])
    state = "struct<pos:bigint,parts:array<string>>"
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("parts")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["pos"].cast("int") + 1, (s["start"] - acc["pos"]).cast("int")), F.lit(mark))
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(s["start"] >= acc["pos"], F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"),
        ).cast(state)

    done = F.aggregate(spans, start, step)
    tail = F.substring(text, F.array_max(ends).cast("int") + 1, F.length(text))
    clean = F.concat(F.array_join(done["parts"], ""), tail)
    cols = docs.columns
    joined = docs.withColumn("__key", row_key(F.col("doc_id"), text)).join(found, F.col("__key") == F.col("__rk"), "left")
    out = joined.withColumn("text", F.when(F.col("__rk").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("__rk").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*cols)
