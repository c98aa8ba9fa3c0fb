"""Secret scans over an incremental ledger of blobs, with DataFrame operations only.

Every version of a document is addressed by the digest of its text. The ledger holds which blob
was scanned under which version of the rules, and what was found; only unseen pairs are scanned,
and the findings are joined back to every path that ever held the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, parted, scratch, steps, stored

# The base patterns, by kind, and the fewest characters of the group that counts.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# Further patterns; what they match counts whole.
MORE = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}", 0, 1),
]
#: A text that a pattern can match holds a match of this; it is shorter to look for.
MARKS = {
    "assign": r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}",
}
RULES = "base-1+more-1"

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
KINDS = [kind for kind, *_ in BASE + MORE]
#: Values of a block of running sums, a power of 2; characters of a piece of a text that is masked. Both keep the work linear in the text.
BLOCK, PIECE = 64, 1024


def before(values: Column, fold, depth: int = 2) -> Column:
    """For each place of an array of longs what `fold` (a sum or the greatest) makes of the values before it; 0 at the first.

    An aggregate that gathers an array copies it at every step. So blocks of BLOCK values are folded
    first, then these in the same way, and a place folds its own block alone: linear in the length.
    """
    zero, block = F.lit(0).cast("long"), lambda i: F.shiftright(i, BLOCK.bit_length() - 1)
    folded = lambda v, first, n: F.aggregate(F.slice(v, first, n), zero, fold)

    def told(v: Column) -> Column:  # transforms of a single element bind a value to a name, so that it is made once
        if not depth:
            return F.transform(v, lambda _, i: folded(v, F.lit(1), i))
        blocks = F.transform(F.sequence(F.lit(0), block(F.greatest(F.size(v) - 1, F.lit(0)))), lambda b: folded(v, b * BLOCK + 1, F.lit(BLOCK)))
        both = F.struct(v.alias("v"), before(blocks, fold, depth - 1).alias("blocks"))
        return F.transform(F.array(both), lambda s: F.transform(s["v"], lambda _, i: fold(F.get(s["blocks"], block(i)), folded(s["v"], block(i) * BLOCK + 1, i % BLOCK))))[0]

    return F.transform(F.array(values), told)[0]


def _spans(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, kind, end) in code points.

    What stands between the matches and the matches themselves give the places. A match whose
    group is shorter than `least` is dropped after it has taken its place.
    """
    rx = F.lit(pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    part = F.regexp_extract_all(text, rx, F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(part, F.length).alias("part"))

    def placed(x: Column) -> Column:
        at = before(F.transform(x, lambda y: (y["gap"] + y["n"]).cast("long")), lambda a, b: a + b)
        both = F.arrays_zip(x.alias("x"), at.alias("at"))
        good = F.filter(both, lambda y: y["x"]["part"] >= least)
        return F.transform(good, lambda y: F.struct((y["at"] + y["x"]["gap"]).alias("start"), F.lit(number).alias("kind"), (y["at"] + y["x"]["gap"] + y["x"]["n"]).alias("end")))

    return F.transform(F.array(lengths), placed)[0]


def findings(text: Column) -> Column:
    """All spans of a text, in order of start, then kind as listed."""
    each = []
    for number, (kind, pattern, group, least) in enumerate(BASE + MORE):
        each.append(F.when(text.rlike(MARKS.get(kind, pattern)), _spans(text, number, pattern, group, least)).otherwise(F.array().cast(SPANS)))
    return F.array_sort(F.concat(*each))


def base_of(spans: Column) -> Column:
    """The spans of the base kinds."""
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


class BlobLedger:
    """A Parquet table of scanned blobs: digest, rules and spans.

    `scan` takes versions (paths with their texts), scans the blobs that the table lacks under
    these rules, appends them, and returns all findings by path.
    """

    def __init__(self, spark, path: str | None = None, rules: str = RULES):
        self.spark, self.path, self.rules = spark, path or scratch(spark, "blob-ledger"), rules

    def seen(self) -> DataFrame:
        schema = f"digest binary, rules string, spans {SPANS}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """digest and text of one version of each blob that the ledger lacks.

        Digests are counted without their texts. Rows whose digest occurs once and is not in the
        ledger stay where they are, told by a filter of bounded size; the texts of the others meet
        in a shuffle, one for each digest and task.
        """
        addressed = versions.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
        known = self.seen().where(F.col("rules") == self.rules).select("digest")
        often = addressed.groupBy("digest").count().where("count > 1").select("digest")
        elsewhere = stored(often.union(known).distinct(), "blobs-elsewhere")
        n = elsewhere.count()
        if not n:
            return addressed.select("digest", "text")
        alone, rest = parted(addressed, "digest", elsewhere, n)
        rest = rest.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
        return alone.select("digest", "text").unionByName(rest)

    def update(self, versions: DataFrame) -> None:
        """Scans unseen blobs and appends them. A blob is appended once, however many rows hold it."""
        with steps(self.spark):
            found = self.unseen(versions).select("digest", F.lit(self.rules).alias("rules"), findings(F.col("text")).alias("spans"))
            found.write.mode("append").parquet(self.path)

    def hits(self) -> DataFrame:
        """digest and spans of every blob with a span under these rules, once, though updates at the same time may have appended it twice."""
        found = self.seen().where((F.col("rules") == self.rules) & (F.size("spans") > 0))
        return stored(found.groupBy("digest").agg(F.first("spans").alias("spans")), "blob-hits")

    def by_path(self, versions: DataFrame, path: str = "doc_id") -> DataFrame:
        """A row for every version: its path, digest and spans from the ledger; no spans where it has none."""
        digests = versions.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))
        return digests.join(self.hits(), "digest", "left").select("path", "digest", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    def scan(self, versions: DataFrame, path: str = "doc_id") -> DataFrame:
        self.update(versions)
        return self.by_path(versions, path)


def secrets_by_document(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """A row for every document: counts of each base kind, the base spans' digest, and all spans.

    A null text counts as empty and has no span; null and repeated ids keep a row each; columns
    other than doc_id and text are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    found = ledger.scan(docs).withColumn("base", base_of(F.col("spans")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").cast("long").alias("doc_id"), *(count(kind) for kind, *_ in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with its spans, in order of their starts, replaced by the mask; spans that overlap become one.

    A place in a string is found by counting from its start, so the text is cut into pieces first.
    """

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Characters a to b, end exclusive."""
        number, within = lambda at: F.floor(at / PIECE).cast("int"), lambda at: (at % PIECE).cast("int")
        first, last = (F.coalesce(F.get(pieces, number(at)), F.lit("")) for at in (a, b))
        between = F.array_join(F.slice(pieces, number(a) + 2, F.greatest(number(b) - number(a) - 1, F.lit(0))), "")
        far = F.concat(F.substring(first, within(a) + 1, F.lit(PIECE)), between, F.substring(last, F.lit(1), within(b)))
        return F.when(number(a) == number(b), F.substring(first, within(a) + 1, (b - a).cast("int"))).otherwise(far)

    def joined(x: Column) -> Column:
        parts = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= F.get(x["done"], i), F.concat(cut(x["pieces"], F.get(x["done"], i), s["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), cut(x["pieces"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length(text).cast("long")))

    done = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.transform(F.array(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans"), done.alias("done"))), joined)[0]


def redacted(docs: DataFrame, ledger: BlobLedger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of their texts replaced by the mask; other columns stay, clean texts stay as they are.

    Overlapping spans become one mask. n_chars, where docs has it, counts the new text. A null
    text stays null; repeated rows each stay; an empty table stays empty. Only rows whose blob has
    a span meet the findings in a shuffle; the others are told by a filter of bounded size.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(docs)
    digest, spans = fresh(docs, "blob_digest"), fresh(docs, "blob_spans")
    known = ledger.hits().select(F.col("digest").alias(digest), F.col("spans").alias(spans))
    n = known.count()
    if not n:
        return docs
    clean, rest = parted(docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))), digest, known.select(digest), n)
    both = rest.join(known, digest, "left")
    text = F.when(F.col(spans).isNull() | F.col("text").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(spans), mask))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns).unionByName(out.select(*docs.columns))
