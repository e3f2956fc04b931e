"""Secret scans with linking of multipart credentials, in DataFrame operations only.

A credential often comes in parts: an access identifier, a secret, an endpoint.  Strong
parts (the base kinds) are reported in any case.  Weak ones (an account name, an
opaque string, an address) are reported only if a complementary part stands within
the same scope: an identifier's and an endpoint's complement is a secret, a secret's is an
identifier or an endpoint.  Parts meet in an interval join within
documents, by bins of the scope's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import doc_ids, identified, kept, read

#: Kind, role, pattern, the group whose length counts, its least length; base kinds first, in the order that ties are listed in.
BASE = (
    ("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "identifier", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", "secret", r"([0-9a-f]+)", 1, 16),
)
#: Maximal runs shorter than the least length are no matches either way, so these two kinds may ask for it at once.
AT_ONCE = {"access": r"(AKIA[A-Z0-9]{14,})", "hex": r"([0-9a-f]{16,})"}
WEAK = (
    ("account", "identifier", r"""(?i:(access_?key_?id|client_?id|account|user(?:name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{20,}={0,2})", 1, 20),
    ("endpoint", "endpoint", r"((?:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x00-\x20\"'<>]+)", 1, 8),
)
KINDS = BASE + WEAK
#: What every match holds, in lower case: texts without any of it aren't searched.  Kinds that aren't listed are tested by their pattern.
HOLDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "account": ("accesskey", "access_key", "clientid", "client_id", "account", "user", "login"),
    "endpoint": ("://",),
}
#: Code points between parts of one credential, at most.
SCOPE = 200


def matches(text: Column, low: Column, kind: tuple) -> Column:
    """An array of (kind, nth, gap before the match, length of the match, length of the group, match); null where
    the text can't have any.  low: the text in lower case."""
    name, _, pattern, group, _ = kind
    pattern = F.lit(AT_ONCE.get(name, pattern))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    inner = whole if group == 1 else F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda v: v)
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), inner.alias("inner"))
    worth = F.lit(False)
    for held in HOLDS.get(name, ()):
        worth = worth | F.contains(low, F.lit(held))
    if name not in HOLDS:
        worth = F.regexp_like(text, pattern)
    found = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(name).alias("kind"),
            i.alias("nth"),
            x["gap"].alias("gap"),
            F.length(x["whole"]).alias("size"),
            F.length(x["inner"]).alias("inner"),
            # only opaque strings are looked at further
            F.when(F.lit(name == "opaque"), x["whole"]).alias("value"),
        ),
    )
    return F.when(worth, found)


def number(kind: Column) -> Column:
    """The kind's place in the list."""
    out = F.lit(len(KINDS))
    for k, x in reversed(list(enumerate(KINDS))):
        out = F.when(kind == x[0], k).otherwise(out)
    return out


def parts(docs: DataFrame) -> DataFrame:
    """(doc, th, kind, role, weak, start, end) of all strong parts and weak candidates; docs is what
    identified() gives, each document once."""
    found = F.filter(F.array(*(matches(F.col("text"), F.col("low"), k) for k in KINDS)), lambda a: a.isNotNull() & (F.size(a) > 1))
    each = docs.withColumn("low", F.lower("text")).select("doc", "th", F.explode(F.flatten(found)).alias("m")).select("doc", "th", "m.*")
    # What lies before a match: all gaps up to it, and all matches before it.
    order = Window.partitionBy("doc", "th", "kind").orderBy("nth")
    before = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = each.withColumn("start", before).where(F.col("size").isNotNull())
    least, role = F.lit(0), F.lit("")
    for name, r, _, _, n in KINDS:
        least, role = F.when(F.col("kind") == name, n).otherwise(least), F.when(F.col("kind") == name, r).otherwise(role)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    return placed.where((F.col("inner") >= least) & ((F.col("kind") != "opaque") | mixed)).select(
        "doc", "th", "kind", role.alias("role"), F.col("kind").isin(*(k[0] for k in WEAK)).alias("weak"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end")
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of parts() that have a complementary part within the scope."""
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    weak = found.where("weak").select("doc", "th", "kind", "role", "start", "end", F.explode(reach).alias("bin"))
    others = found.select("doc", "th", F.col("role").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    near = (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope)
    apart = (F.col("to") <= F.col("start")) | (F.col("from") >= F.col("end"))
    complementary = (F.col("role") == "secret") != (F.col("other") == "secret")
    return weak.join(others, ["doc", "th", "bin"]).where(near & apart & complementary).select("doc", "th", "kind", "start", "end").distinct()


def reported(docs: DataFrame, scope: int) -> DataFrame:
    """(doc, th, kind, start, end): the base spans and the weak ones that have a complement."""
    found = kept(parts(docs))
    return found.where("not weak").select("doc", "th", "kind", "start", "end").unionByName(linked(found, scope))


def spans_by_document(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc, th, spans): the reported spans of each document that has any, by start and kind, as
    (start, place of the kind, end, kind, weak)."""
    one = F.struct("start", number(F.col("kind")).alias("nth"), "end", "kind", (number(F.col("kind")) >= len(BASE)).alias("weak"))
    return reported(docs, scope).groupBy("doc", "th").agg(F.array_sort(F.collect_set(one)).alias("spans"))


def runs_by_document(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc, th, runs): the reported spans, those that overlap or touch as one (start, end), ascending."""
    order = Window.partitionBy("doc", "th").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = reported(docs, scope).withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1))
    run = first.withColumn("run", F.sum("new").over(order)).groupBy("doc", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return run.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def once(docs: DataFrame, unique: bool) -> DataFrame:
    return docs if unique else docs.dropDuplicates(["doc", "th"])


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: start, end (code points, end exclusive), kind, and whether it is weak.

    Null and empty texts have no spans.  Rows that agree in id and text are one document, reported
    as often as it occurs.
    """
    source, unique = identified(docs, doc_id, text)
    found = spans_by_document(once(source, unique), scope)
    none = F.array().cast("array<struct<start:bigint,nth:int,end:bigint,kind:string,weak:boolean>>")
    return source.select("doc", "th").join(found, ["doc", "th"], "left").select(doc_ids().alias("doc_id"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with every reported span masked in its text; spans that touch share one mask.  All rows and columns stay,
    whatever their names; null and empty texts stay as they are, and rows that agree in id and text are masked alike."""
    named = docs.withColumn("__all", F.struct(*docs.columns))
    source, unique = identified(named, doc_id, text, ("__all",))
    found = runs_by_document(once(source.select("doc", "th", "text"), unique), scope)
    body, runs = F.col("text"), F.col("runs")
    cut = lambda start, end: F.substring(body, (start + 1).cast("int"), (end - start).cast("int"))
    before = F.transform(runs, lambda r, i: cut(F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["end"]).otherwise(0), r["start"]))
    last = F.element_at(runs, -1)["end"]
    masked = F.concat(F.array_join(before, mask), F.lit(mask), cut(last, F.length(body)))
    joined = source.join(found, ["doc", "th"], "left")
    new = F.when(runs.isNull(), body).otherwise(masked)
    return joined.select("__all", new.alias("__text")).select(*(F.col("__text").alias(c) if c == text else F.col("__all")[c].alias(c) for c in docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: ~s["weak"])
    return scan(read(spark, sf_dir, "documents")).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
