r"""Document fingerprints as Merkle trees, with Spark's own functions only.

A section is a line with its line feed; within it, a paragraph ends after a mark of
``.!?,;:|`` and a space, or after a wide mark such as an ideographic full stop. What is
longer than ``LONG`` characters without one is cut after words that end in ``a`` or ``e``;
what is still longer, into pieces of ``LONG``: an edit changes few paragraphs of any text,
and none is longer than ``LONG``. A paragraph's digest is SHA-256 of its text, a section's
of its paragraphs' digests, the root's of the sections' digests. Equal roots mean equal texts.

Two trees are compared from the root down: sections with equal digests at the same place
are equal and aren't entered; those that differ are, and their paragraphs are compared.
``differences`` gives the places. Likeness is Dice's coefficient, weighted by length, over
the equal sections and the distinct paragraphs of the others; equal roots have likeness 1.

A null text counts as empty: one empty paragraph. Rows with the same doc_id share their
place in the order; the row whose text has the smallest hash stands for them as the next
document of others. A null doc_id comes last; such rows are dealt by their texts, too, so
that any number of them is spread. An empty table gives an empty result; one document is
its own next. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, durable

SECTION = r"(?<=\n)(?!\z)"
WIDE = "\u3002\uff01\uff1f\uff0c\uff1b\uff1a\u3001"
PARAGRAPH = rf"(?:(?<=[.!?,;:|]\x20)|(?<=[{WIDE}]))(?!\z)"
WORDS = r"(?<=[ae]\x20)(?!\z)"
#: Characters of a paragraph at most.
LONG = 256
#: A paragraph's identity in a comparison: 48 bits of hash, 16 of its length.
LENGTH_BITS = 65535
LEAST_LONG = "-9223372036854775808"
#: Parts in which rows without an id are dealt.
SPREAD = 64


def leaves(section: Column) -> Column:
    """The paragraphs of a section."""
    cut = lambda p: F.when(F.length(p) > LONG, F.regexp_extract_all(p, F.lit(r"(?s).{1,%d}" % LONG), F.lit(0))).otherwise(F.array(p))
    words = lambda p: F.when(F.length(p) > LONG, F.flatten(F.transform(F.split(p, WORDS), cut))).otherwise(F.array(p))
    found = F.split(section, PARAGRAPH)
    return F.when(F.length(section) > LONG, F.flatten(F.transform(found, words))).otherwise(found)


def tree(text: Column) -> Column:
    """Sections, each an array of paragraphs (digest, mark)."""

    def paragraph(p: Column) -> Column:
        mark = F.xxhash64(p).bitwiseAND(F.lit(~LENGTH_BITS)).bitwiseOR(F.length(p).cast("long"))
        return F.struct(F.sha2(p, 256).alias("digest"), mark.alias("mark"))

    return F.transform(F.split(text, SECTION), lambda s: F.transform(leaves(s), paragraph))


def section_digest(section: Column) -> Column:
    return F.sha2(F.array_join(section["digest"], ""), 256)


def root(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, section_digest), ""), 256)


def compact(nodes: Column) -> Column:
    """Sections as (digest's hash, marks of the paragraphs): what a comparison needs."""
    return F.transform(nodes, lambda s: F.struct(F.xxhash64(section_digest(s)).alias("h"), s["mark"].alias("marks")))


def weight(marks: Column) -> Column:
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(LENGTH_BITS).cast("long")))


def compared(a: Column, b: Column) -> Column:
    """Of two compact trees: length of the sections equal at their place, marks of the others on either side.

    A struct (same, left, right); sections beyond the other tree's end have nothing to equal.
    """
    none = F.expr("cast(array() as array<bigint>)")
    of = lambda x: F.coalesce(x["marks"], none)

    def section(x: Column, y: Column) -> Column:
        same = x["h"].eqNullSafe(y["h"])
        return F.struct(F.when(same, weight(of(x))).otherwise(0).alias("same"), F.when(same, none).otherwise(of(x)).alias("left"), F.when(same, none).otherwise(of(y)).alias("right"))

    return F.zip_with(a, b, section)


def likeness(places: Column, equal: Column) -> Column:
    """Of what ``compared`` gives; ``equal``: whether the roots are."""
    same = F.aggregate(places, F.lit(0).cast("long"), lambda total, x: total + x["same"])
    left, right = (F.array_distinct(F.flatten(places[side])) for side in ("left", "right"))
    both = 2 * same + weight(left) + weight(right)
    return F.when(equal, 1.0).when(both > 0, 2.0 * (same + weight(F.array_intersect(left, right))) / both).otherwise(0.0)


def differences(a: Column, b: Column) -> Column:
    """(section, paragraph) places at which two trees differ; sections with equal digests aren't entered."""

    def sections(x: Column, y: Column) -> Column:
        same = F.coalesce(section_digest(x) == section_digest(y), F.lit(False))
        flags = F.zip_with(F.coalesce(x["digest"], F.array()), F.coalesce(y["digest"], F.array()), lambda p, q: ~p.eqNullSafe(q))
        at = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        return F.when(same, F.expr("cast(array() as array<int>)")).otherwise(at)

    found = F.zip_with(a, b, sections)
    return F.flatten(F.transform(found, lambda at, s: F.transform(at, lambda p: F.struct(s.alias("section"), p.alias("paragraph")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), root(tree(text)).alias("fingerprint"))


def order_key(doc_id: Column) -> Column:
    """Sorts as doc_id does, a null below all."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(LEAST_LONG).cast("decimal(20,0)") - 1).cast("decimal(20,0)")


def _spread(key: Column, text_hash: Column) -> Column:
    """Part in which a row is dealt beside its key: by its text if it has no id."""
    return F.when(key < F.lit(LEAST_LONG).cast("decimal(20,0)"), F.pmod(text_hash, F.lit(SPREAD))).otherwise(0).cast("int")


def next_ids(docs: DataFrame) -> DataFrame:
    """(key, next_key, need, next_hash): each distinct id's next one in descending order, a third of its length, and the hash of the next one's text.

    Ids alone are dealt by range; neighbours are found within a range, and at its end
    from the table of ranges, which has a row for each partition.
    """
    text = F.coalesce("text", F.lit(""))
    ids = docs.select(order_key(F.col("doc_id")).alias("key"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    ids = ids.groupBy("key").agg(F.floor(F.max("n") / 3).cast("int").alias("need"), F.min("h").alias("h"))
    ids = durable(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    parts = ids.groupBy("part").agg(F.max(F.struct("key", "h")).alias("most"))
    down = Window.orderBy(F.desc("part"))
    all_parts = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.lead("most").over(down), F.max("most").over(all_parts)).alias("after"))
    within = Window.partitionBy("part").orderBy(F.desc("key"))
    ids = ids.withColumn("below", F.lead(F.struct("key", "h")).over(within))
    return ids.join(parts, "part").withColumn("next", F.coalesce("below", "after")).select("key", F.col("next.key").alias("next_key"), "need", F.col("next.h").alias("next_hash"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text with the last third replaced, and both likenesses."""
    order = durable(next_ids(docs))
    # one exchange of the texts serves givers and takers: both read the same columns
    rows = docs.select(order_key(F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("key", _spread(F.col("key"), F.xxhash64("text")).alias("at"), "text").repartition("key", "at")
    asked = order.select(F.col("next_key").alias("key"), _spread(F.col("next_key"), F.col("next_hash")).alias("at"), "next_hash", F.col("key").alias("taker"), "need")
    one = Window.partitionBy("key", "at").orderBy(F.xxhash64("text"))
    given = rows.withColumn("row", F.row_number().over(one)).where("row = 1").join(asked, ["key", "at"])
    # not as an equality: as one it would be a key of the join, by which the texts would be exchanged again
    given = given.where(F.xxhash64("text").bitwiseXOR(F.col("next_hash")) == 0)
    taken_at = F.when(F.col("taker") < F.lit(LEAST_LONG).cast("decimal(20,0)"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    given = given.select(F.col("taker").alias("key"), taken_at.alias("ats"), F.substring("text", F.lit(1), F.col("need")).alias("head"), compact(tree(F.col("text"))).alias("next_tree"), F.sha2("text", 256).alias("next_sha"))
    given = given.withColumn("at", F.explode("ats")).drop("ats")
    both = rows.join(given, ["key", "at"]).withColumn("n_chars", F.length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("head", F.lit(1), third)))
    doc_id = F.when(F.col("key") >= F.lit(LEAST_LONG).cast("decimal(20,0)"), F.col("key").cast("long"))
    both = both.select(
        doc_id.alias("doc_id"), "n_chars", F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha256"), "next_sha", "next_tree",
        tree(F.col("text")).alias("nodes"), tree(F.col("edited")).alias("edited_nodes"),
    )
    both = both.select("*", root(F.col("nodes")).alias("fingerprint"), root(F.col("edited_nodes")).alias("edited_fingerprint"), compact(F.col("nodes")).alias("own"))
    both = both.select("*", compared(F.col("own"), compact(F.col("edited_nodes"))).alias("by_edit"), compared(F.col("own"), F.col("next_tree")).alias("by_next"))
    return both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("by_edit"), F.col("sha") == F.col("edited_sha256")).alias("near_edited"),
        likeness(F.col("by_next"), F.col("sha") == F.col("next_sha")).alias("near_next"),
    )


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))


QUERIES = {"op7_merkle": op7_merkle}

# SQL has no look-behind: it splits at a character put in where a section or paragraph ends.
def _pieces(t: str) -> str:
    def split(x: str, after: str) -> str:
        # an empty last piece isn't one, unless the text is empty
        return f"list_filter(string_split(regexp_replace({x}, '({after})', '\\1' || chr(1), 'g'), chr(1)), lambda q: q <> '' OR {x} = '')"

    cut = f"CASE WHEN len(w) > {LONG} THEN regexp_extract_all(w, '(?s).{{1,{LONG}}}') ELSE [w] END"
    words = f"CASE WHEN len(p) > {LONG} THEN flatten(list_transform({split('p', '[ae] ')}, lambda w: {cut})) ELSE [p] END"
    marks = "[.!?,;:|] |[" + WIDE + "]"
    return f"list_transform({split(t, chr(92) + 'n')}, lambda s: flatten(list_transform({split('s', marks)}, lambda p: {words})))"


def _near(a: str, b: str) -> str:
    """Likeness of two trees whose texts differ."""
    same = f"coalesce(list_sum(list_transform(list_filter(list_zip({a}, {b}), lambda z: z[1] IS NOT DISTINCT FROM z[2]), lambda z: list_sum(list_transform(z[1], lambda p: len(p))))), 0)"
    others = f"list_filter(list_zip({a}, {b}), lambda z: z[1] IS DISTINCT FROM z[2])"
    left, right = (f"list_distinct(flatten(list_transform({others}, lambda z: coalesce(z[{i}], []::VARCHAR[]))))" for i in (1, 2))
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda p: len(p))), 0)"
    both = f"(2 * {same} + {size(left)} + {size(right)})"
    return f"CASE WHEN {both} > 0 THEN 2.0::DOUBLE * ({same} + {size(f'list_intersect({left}, {right})')}) / {both} ELSE 0.0 END"


def _root(x: str) -> str:
    return f"sha256(list_aggregate(list_transform({x}, lambda s: sha256(list_aggregate(list_transform(s, lambda p: sha256(p)), 'string_agg', ''))), 'string_agg', ''))"


ORACLES = {
    "op7_merkle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS following,
    first(coalesce(text, '')) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM documents),
e AS (SELECT doc_id, text, len(text) AS n, coalesce(following, top) AS nx FROM d),
f AS (SELECT *, text[:n - n // 3] || CASE WHEN n // 3 > 0 THEN nx[:n // 3] ELSE '' END AS edited FROM e),
g AS (SELECT *, {_pieces('text')} AS a, {_pieces('edited')} AS b, {_pieces('nx')} AS c FROM f)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_root('a')} AS fingerprint, {_root('b')} AS edited_fingerprint,
  (CASE WHEN text = edited THEN 1.0 ELSE {_near('a', 'b')} END)::DOUBLE AS near_edited,
  (CASE WHEN text = nx THEN 1.0 ELSE {_near('a', 'c')} END)::DOUBLE AS near_next
FROM g""",
}
