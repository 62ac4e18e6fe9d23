"""Exact document fingerprints: canonical text, wide xxhash digest, byte comparison inside equal digests.

Everything here is a DataFrame expression. The canonical text is NFKC-composed and case-folded (by the ICU
library that Spark itself ships), composed again, with every run of white space folded to one blank and
none at the ends. The fingerprint is two 64-bit xxhash values under different seeds, as 32 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, table

#: Documents in one stretch of the ordered ids; quantiles of the ids, and quantiles at most
#: of the ids between two of those, that the stretches are laid out between.
STRETCH, QUANTILES, INNER_QUANTILES = 512, 128, 64
#: Repeated digests are broadcast up to this many (16 bytes each), and a quarter as many
#: classes (about 64 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def canonical(text: Column) -> Column:
    """Canonical form of a text; a null text is like an empty one."""
    text = F.coalesce(text, F.lit(""))
    icu = lambda kind, method, value: F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), value, F.lit(True))
    compose = lambda value: icu("text.Normalizer", "compose", value)
    # of ASCII text, the lower case is all of that
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(compose(icu("lang.UCharacter", "foldCase", compose(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def halves(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit("first"), canon), F.xxhash64(F.lit("second"), canon)


def digest(canon: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves(canon))))


def exact_classes(docs: DataFrame) -> DataFrame:
    """Rows (fingerprint, canon_rank, class_id, copies) for canonical texts that occur more than once.

    Digests are counted first; only documents whose digest repeats are looked at again, and those are
    grouped by digest and canonical bytes, so that a collision of digests gives several classes of one
    fingerprint (canon_rank 1, 2, ... by class_id; practically always one). Copies meet in partial
    aggregates in each task, so a large group of copies is never gathered.
    """
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    h1, h2 = halves(F.col("canon"))
    keyed = canon.select("doc_id", "canon", h1.alias("h1"), h2.alias("h2"))
    repeated = checkpointed(keyed.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    small = repeated.count() <= BROADCAST_ROWS
    members = keyed.join(F.broadcast(repeated) if small else repeated, ["h1", "h2"], "left_semi")
    classes = members.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("class_id", "canon"))
    name = F.lower(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    return classes.select(name.alias("fingerprint"), rank.alias("canon_rank"), "class_id", "copies", "canon")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the document with the next smaller id; after the smallest, the largest.

    Rows of equal id stand by text, descending; rows without an id come last, by a hash of the text and
    the text. Null texts are empty. The ids are laid out in stretches of about STRETCH documents between
    quantiles of the ids, so that no task orders the whole table: neighbours are found inside a stretch,
    and the last row of a stretch gets the first row of the next one that has rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    share = lambda n: [k / n for k in range(n + 1)]
    count, without, cuts = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", share(QUANTILES), 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    above = lambda bounds, value: F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= value)))
    inner = max(1, min(INNER_QUANTILES, -(-count // (len(cuts) * STRETCH))))
    parts = max(1, -(-count // (len(cuts) * inner * STRETCH)))
    every = F.array(*(F.lit(x).cast("long") for x in cuts))
    outer = above(every, F.col("doc_id"))
    # how far an id is above its outer quantile, as a double: exact unless that is very far; the difference may pass a long
    cut, wide = F.element_at(every, outer), lambda value: value.cast("double")
    offset = F.coalesce(wide(F.try_subtract("doc_id", cut)), wide(F.col("doc_id")) - wide(cut))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").select(outer.alias("outer"), offset.alias("offset"))
    bounds = ids.groupBy("outer").agg(F.array_sort(F.array_distinct(F.percentile_approx("offset", share(inner), 1_000))).alias("bounds"))  # QUANTILES + 1 rows at most
    rows = rows.withColumns({"outer": F.when(F.col("doc_id").isNotNull(), outer), "offset": offset}).join(F.broadcast(checkpointed(bounds)), "outer", "left")
    at = above(F.col("bounds"), F.col("offset"))
    low, high = F.get("bounds", at - 1), F.coalesce(F.get("bounds", at), F.get("bounds", at - 1))
    inside = F.floor((F.col("offset") - low) / F.greatest(F.lit(1.0), high - low) * parts)
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))
    cell = (F.col("outer").cast("long") * (inner + 2) + at) * parts + inside
    lost, place = max(1, -(-without // STRETCH)), F.xxhash64("text")  # stretches of the rows without an id, below all others
    sunk = F.least(F.lit(lost - 1), F.floor((wide(place) / 2.0**64 + 0.5) * lost)) - lost
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), sunk).otherwise(cell).cast("long").alias("stretch"), F.when(F.col("doc_id").isNull(), place).alias("hash"))
    band = F.floor(F.col("stretch") / ((inner + 2) * parts)).alias("band")
    dealt = rows.repartition("stretch")
    order = Window.partitionBy("stretch").orderBy(F.desc_nulls_last("doc_id"), F.desc("hash"), F.desc("text"))
    placed = dealt.withColumn("following", F.lead("text").over(order))
    heads = dealt.withColumn("place", F.row_number().over(order)).where("place = 1").select("stretch", F.col("text").alias("head"))
    # which stretch each head follows: the next below in the same band, else the highest of the bands below
    found = dealt.select("stretch").distinct().select("stretch", band)
    bands = found.groupBy("band").agg(F.max("stretch").alias("highest"))  # a row for each outer quantile, and for as many stretches without ids
    bands = bands.select("band", F.lead("highest").over(Window.orderBy(F.desc("band"))).alias("lower"), F.max("highest").over(Window.partitionBy()).alias("top"))
    near = F.lead("stretch").over(Window.partitionBy("band").orderBy(F.desc("stretch")))
    links = found.withColumn("near", near).join(F.broadcast(bands), "band").select("stretch", F.coalesce("near", "lower", "top").alias("below"))
    after = links.join(heads.withColumnRenamed("stretch", "below"), "below").select("stretch", "head")
    return placed.join(after, "stretch").select("doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, copies).

    A null text counts as an empty one. The edited text has the last half of the code points replaced from
    the next document. A likeness is 1 if the digests and then the canonical bytes are equal, else 0.
    class_id is the smallest id with the same canonical text, copies their number.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    # each canonical text and digest is a column of its own: Spark would work an expression that calls Java out at every mention
    wide = with_next(docs).withColumn("edited", edited)
    canon = wide.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *(canonical(F.col(t)).alias(f"canon_{t}") for t in ("text", "edited", "next_text")),
    )
    known = canon.select("*", *(digest(F.col(f"canon_{t}")).alias(f"digest_{t}") for t in ("text", "edited", "next_text")))
    alike = lambda other: F.when(F.col("digest_text") != F.col(f"digest_{other}"), F.lit(0.0)).otherwise((F.col("canon_text") == F.col(f"canon_{other}")).cast("double"))
    out = known.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("digest_text").alias("fingerprint"),
        F.col("digest_edited").alias("edited_fingerprint"),
        alike("edited").alias("near_edited"),
        alike("next_text").alias("near_next"),
    )
    classes = checkpointed(exact_classes(docs).select("fingerprint", "canon_rank", "class_id", "copies"))
    # cut off from its aggregate, so that Spark can split the join where very many documents share a fingerprint
    single = checkpointed(classes.groupBy("fingerprint").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("texts")))
    out = out.join(F.broadcast(single) if single.count() <= BROADCAST_ROWS // 4 else single, "fingerprint", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("texts", F.lit(1)).alias("texts_of_fingerprint"),
    )


def op7_fingerprint(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
