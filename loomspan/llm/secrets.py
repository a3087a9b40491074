"""Secret scans: candidates by pattern, verdicts by how many repositories and owners share a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, table, written

#: Kinds in their order: pattern, group that holds the value, least length of that group.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]+)", 1, 32),
}
#: What the method adds: well-known token shapes, private keys, passwords in addresses.
MORE = {
    "github": (r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    "slack": (r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15),
    "jwt": (r"([A-Za-z0-9_.-]{30,})", 1, 30),
    "pem": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 10),
    "url": (r"[a-z][a-z0-9+.-]{0,19}://[^\s/:@]+:([^\s/@]{6,})@", 1, 6),
}
#: Of a kind's match, the part at its beginning that is the value and ends the span. All patterns take time in
#: proportion to the text, and no repeated group: Java's matcher calls itself for each turn of one.
INNER = {"jwt": r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"}
#: A value that more owners than this share is a copied example, one of fewer is live-looking.
OWNERS = 2
#: Parts in which the documents of one value meet its counts.
SALTS = 8
#: A kind's pattern for a quick look, before any span is made.
LOOK = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "jwt": "eyJ[A-Za-z0-9_-]{8}", "pem": "PRIVATE KEY-----"}


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, end, kind, value>> of a kind's matches, leftmost and non-overlapping.

    Spark has no function for the places of matches: they follow from the lengths of the matches
    and of the pieces between them, in code points.
    """
    rank = [*BASE, *MORE].index(kind)
    look = text.rlike(LOOK.get(kind, pattern))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["match"])
        stop = start + F.length(x["value"]) if kind in INNER else end
        span = F.struct(start.alias("start"), stop.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    if kind in INNER:
        values = F.transform(values, lambda x: F.regexp_extract(x, INNER[kind], 0))
    if kind == "hex":  # nearly every word has a short run; longer runs alone, which are the same spans
        pattern = r"([0-9a-f]{32,})"
        pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        found = values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = F.zip_with(F.zip_with(found, values, lambda m, v: F.struct(m.alias("match"), v.alias("value"))), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, g: F.struct(m["match"].alias("match"), m["value"].alias("value"), g.alias("gap")))
    spans = F.aggregate(rows, zero, step, lambda a: a["spans"])
    full = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    return F.when(look, full).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` and ``found``: sorted arrays of spans. They replace columns
    of these names; all other columns are carried along.

    ``found`` has the base kinds' spans and the further ones. A null text is an empty one.
    """
    kinds = {**BASE, **MORE}
    d = packed(docs, _t=F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({f"_{k}": spans_of(F.col("_t"), k, *v) for k, v in kinds.items()})
    d = d.withColumn("base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE])))
    d = d.withColumn("found", F.array_sort(F.concat("base", *[F.col(f"_{k}") for k in MORE])))
    return d.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (text, "base", "found")], "base", "found")


def judged(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """The distinct rows (doc_id, spans) of ``found`` with spans, with n_live, n_example and verdicts.

    A value's hash is counted over distinct repositories and owners. Pairs are made distinct
    before they are shuffled, so a value that a third of all documents copy is one row per
    repository. More than OWNERS owners make an example; a value of few owners is live-looking.
    """
    rows = found.select("doc_id", "spans", repository.alias("repo"), owner.alias("owner"), "found").withColumn("s", F.explode("found"))
    rows = rows.withColumn("value", F.sha2(F.col("s.value"), 256)).select("doc_id", "spans", "repo", "owner", "s", "value")
    spread = rows.select("value", "repo", "owner").distinct().groupBy("value").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    one = rows.select("doc_id", "spans", F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), "value").distinct()
    # a value that many documents have is spread over SALTS parts of the join
    one = one.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    one = one.join(spread.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["value", "salt"])
    live = F.col("n_owners") <= OWNERS
    return one.groupBy("doc_id", "spans").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
        F.max("n_repos").alias("most_repos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "rank", live.alias("live")))), lambda x: F.when(x["live"], "live").otherwise("example")), ",").alias("verdicts"),
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Repositories are the sources; an owner is a source's name up to the first '/' or ':'.

    Rows with equal id and spans are judged alike. Rows without spans have empty verdicts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    found = found.select("doc_id", "source", "found", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
    found = written(found, "se-found")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    verdicts = judged(found.filter("spans <> ''"), source, F.regexp_extract(source, "^[^/:]*", 0))
    v = verdicts.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"), "n_live", "n_example", "most_repos", "verdicts")
    out = found.join(v, found["doc_id"].eqNullSafe(v["_id"]) & (found["spans"] == v["_spans"]), "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("most_repos", F.lit(0)).alias("most_repos"), F.coalesce("verdicts", F.lit("")).alias("verdicts"))
