"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of sentences, in DataFrame functions only.

Sections end at blank lines, paragraphs at line ends, pieces at sentence ends or PIECE code points; every separator
stays with what it ends, so the pieces joined are the text. A node is the SHA-256 of its children's digests, a piece's
of its characters. Roots are equal for equal texts only (up to SHA-256); the fingerprint also carries shortened inner
nodes and pieces. Two trees are compared from the root down: what stands in equal sections is alike, of the others the
equal paragraphs, of the others the equal pieces. Likeness is the number of pieces alike by that of all; a branch that
repeats among the differing ones counts once. It is 1 for equal texts only. Differing paragraphs locate an edit.

Null texts count as empty: a tree of no sections. Null doc_ids sort first, equal doc_ids by text. Every row gives one
row; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

PIECE = 60
SECTION_END, PARAGRAPH_END = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
PIECES = rf"(?s)([^.!?]{{1,{PIECE}}}(?:[.!?]+\s*)?|[.!?]+\s*)"
#: Hexadecimal digits kept of an inner node and of a piece.
NODE, LEAF = 16, 8
#: Ranges of doc_id for each shuffle partition.
RANGES = 4


def digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


def tree(text: Column) -> Column:
    """array<struct<node, paragraphs: array<struct<node, leaves: array<string>>>>>, a struct for each section."""
    parts = lambda x, end: F.filter(F.split(x, end), lambda p: p != "")
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(1)), lambda x: F.sha2(x.cast("binary"), 256))
    node = lambda children, name: F.struct(digest(children if name == "leaves" else F.transform(children, lambda c: c["node"])).alias("node"), children.alias(name))
    paragraphs = lambda s: F.transform(F.transform(parts(s, PARAGRAPH_END), leaves), lambda x: node(x, "leaves"))
    return F.transform(F.transform(parts(F.coalesce(text, F.lit("")), SECTION_END), paragraphs), lambda x: node(x, "paragraphs"))


def serialised(sections: Column) -> Column:
    """root|section=paragraph-leaves,paragraph-leaves;section=..."""
    paragraph = lambda p: F.concat(F.left(p["node"], F.lit(NODE)), F.lit("-"), F.array_join(F.transform(p["leaves"], lambda x: F.left(x, F.lit(LEAF))), ""))
    section = lambda s: F.concat(F.left(s["node"], F.lit(NODE)), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(digest(F.transform(sections, lambda s: s["node"])), F.lit("|"), F.array_join(F.transform(sections, section), ";"))


def fingerprint(text: Column) -> Column:
    return serialised(tree(text))


def sections(print_: Column) -> Column:
    """The serialised sections of a fingerprint."""
    return F.filter(F.split(F.substring_index(print_, "|", -1), ";"), lambda s: s != "")


def paragraphs(of: Column) -> Column:
    """The serialised paragraphs of sections."""
    return F.flatten(F.transform(of, lambda s: F.split(F.substring_index(s, "=", -1), ",")))


def pieces(of: Column) -> Column:
    """The shortened pieces of paragraphs."""
    return F.flatten(F.transform(of, lambda p: F.regexp_extract_all(F.substring_index(p, "-", -1), F.lit(f"([0-9a-f]{{{LEAF}}})"), F.lit(1))))


def n_pieces(print_: Column) -> Column:
    """How many pieces a fingerprint has, from its length: a section has NODE + 1 characters of its own, a paragraph NODE + 2."""
    body, split = F.substring_index(print_, "|", -1), F.size(sections(print_))
    of_paragraphs = F.length(body) - F.length(F.replace(body, F.lit("-"), F.lit("")))
    return F.when(split == 0, 0).otherwise((F.length(body) + 1 - (NODE + 1) * split - (NODE + 2) * of_paragraphs) / LEAF)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the likeness of two fingerprints, found by walking down the branches that differ."""
    kept, side = rows.columns, lambda c: F.col(f"_{c}")
    only = lambda x, y: F.array_except(side(x), side(y))
    rows = rows.withColumns({"_a": sections(F.col(a)), "_b": sections(F.col(b))})
    rows = rows.withColumns({"_c": paragraphs(only("a", "b")), "_d": paragraphs(only("b", "a"))})
    rows = rows.withColumns({"_e": pieces(only("c", "d")), "_f": pieces(only("d", "c")), "_n": n_pieces(F.col(a)), "_m": n_pieces(F.col(b))})
    alike = F.least(side("n") - F.size(only("e", "f")), side("m") - F.size(only("f", "e")))
    all_ = side("n") + side("m")
    told = F.when(root(F.col(a)) == root(F.col(b)), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(alike / F.greatest(F.lit(1.0), all_ - alike), 1 - 1 / (all_ + 1))))
    return rows.select(*kept, told.alias(name))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """struct<first, last>: numbers, from 0, of the first and last paragraph of ``a`` that differ from ``b``; null for equal texts, last < first where only ``b`` has some."""
    nodes = lambda x: F.transform(paragraphs(sections(x)), lambda p: F.left(p, F.lit(NODE)))
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    own, other = nodes(a), nodes(b)
    first = differ(own, other) - 1
    last = F.size(own) - differ(F.reverse(own), F.reverse(other))
    return F.when(root(a) != root(b), F.struct(first.alias("first"), F.greatest(first - 1, last).alias("last")))


def ranged_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, only_follows, to): rows dealt by ranges of doc_id, so that lead() inside ``to`` finds the next document, the first after the last.

    The ids are cut into ranges of about equal counts; each range is a window of its own, and the first row of a
    range is also sent to the range before, as the one row that only follows there.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark) * RANGES
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()[0]
    bounds = sorted(set(bounds or []))
    low = F.lit(0)
    if bounds:  # how many bounds are at most the id, by halving steps
        ends = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one literal
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        take = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(ends, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)
        low = F.aggregate(steps, F.lit(0), take)
    ranged = docs.withColumn("range", low)
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).collect())
    follows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the last range for the very first row
    extra = spark.createDataFrame(follows, "first long, goes_to int")  # a row for each range: at most RANGES * partitions
    key = F.coalesce(ranged["doc_id"], F.lit(-(2**63)))
    sent = ranged.join(F.broadcast(extra), key == extra["first"], "left").select(
        "doc_id", "text", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("only_follows"), F.col("range").alias("to")), F.when(F.col("goes_to").isNotNull(), F.struct(F.lit(1).alias("only_follows"), F.col("goes_to").alias("to")))))).alias("sent")
    )
    return sent.select("doc_id", "text", "sent.only_follows", "sent.to")


def edited_prints(docs: DataFrame) -> DataFrame:
    ordered = Window.partitionBy("to").orderBy("only_follows", F.col("doc_id").asc_nulls_first(), "text")
    rows = ranged_rows(docs).withColumn("next_text", F.lead("text").over(ordered)).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("next_print", F.lead("fingerprint").over(ordered)).where("only_follows = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_print", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    rows = likeness(likeness(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_print", "near_next")
    edit = differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", edit["first"].alias("edit_first_paragraph"), edit["last"].alias("edit_last_paragraph"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(table(spark, sf_dir, "documents"))
