"""References to records that do not exist.

A Bloom filter of the parent keys is built as a distributed aggregation (``bit_or`` per 64-bit word) and handed to the
reference scan as a scalar subquery, so the test is a JVM expression in the scan's own stage. A key the filter does not
hold is a definite orphan: it only has to be still in its record's latest state, and never meets the parents. Only
filter-positive references go through the exact join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.links import content_targets, target_set
from marginalia.session import materialize

#: Bits a key takes at least, hash functions, and the largest filter that is broadcast (2^26 bits = 8 MB).
BITS_PER_KEY, HASHES, MAX_BITS = 10, 5, 1 << 26


def _positions(key: Column, bits: int) -> list[Column]:
    a, b = (F.pmod(h, F.lit(bits)) for h in (F.xxhash64(key), F.xxhash64(key, F.lit("bloom"))))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def bloom_size(keys: int) -> int:
    """Bits for so many keys: a power of two, at least 1,024. 0 where the filter would pass :data:`MAX_BITS`."""
    bits = 1024
    while bits < BITS_PER_KEY * keys:
        bits *= 2
    return bits if bits <= MAX_BITS else 0


def bloom_words(parents: DataFrame, key: str, bits: int) -> DataFrame:
    """One row, one array of ``bits / 64`` longs: the filter of ``parents[key]``. Its size depends on ``bits`` only."""
    at = F.explode(F.array(*_positions(F.col(key), bits)))
    set_bits = parents.where(F.col(key).isNotNull()).select(at.alias("p"))
    words = set_bits.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    every = parents.sparkSession.range(bits // 64).withColumnRenamed("id", "w")
    dense = every.join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("s"))
    return dense.agg(F.sort_array(F.collect_list("s")).alias("s")).select(F.col("s.v").alias("words"))


def might_contain(words: Column, key: Column, bits: int) -> Column:
    """False means the key is certainly not a parent; a null key is never one."""
    hit = F.lit(True)
    for p in _positions(key, bits):  # the same subquery each time: it runs once; higher-order functions may not hold one
        word = F.get(words, (p / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, (p % 64).cast("int")) == 1)
    return F.coalesce(hit & key.isNotNull(), F.lit(False))


def parent_test(parents: DataFrame, parent_key: str) -> Callable[[Column], Column]:
    """A test of a reference's key for the scan that reads it: False means it is certainly no key of ``parents``, which has one
    row per key. Above the filter's size bound nothing is broadcast and every reference is taken to be positive."""
    bits = bloom_size(parents.select(F.approx_count_distinct(parent_key)).first()[0])
    if not bits:
        return lambda key: key.isNotNull()
    words = bloom_words(parents.select(parent_key), parent_key, bits).scalar()
    return lambda key: might_contain(words, key, bits)


def split_references(refs: DataFrame, ref_key: str, parents: DataFrame, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(definite orphans, filter-positive references); see :func:`parent_test`.

    An empty parent table makes every reference a definite orphan. References with a null key name nothing and are dropped.
    """
    test = parent_test(parents, parent_key)
    tagged = refs.where(F.col(ref_key).isNotNull()).withColumn("__hit", test(F.col(ref_key)))
    return tagged.where(~F.col("__hit")).drop("__hit"), tagged.where("__hit").drop("__hit")


def note_references(notes: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Distinct references of each note's state: ``note_id, ref_field, target, hit, first_seen``.

    A reference counts if the note's latest row has it and is not deleted; ``first_seen`` is the first row that had it
    in that field. Bodies are parsed where they are scanned, so only links shuffle, and ``hit``, what ``test`` says of the
    target, is asked there too. Null and blank targets are none.
    """
    def tagged(field: str, targets: Column) -> Column:
        return F.transform(targets, lambda t: F.struct(F.lit(field).alias("ref_field"), t.alias("target")))

    named = F.concat(tagged("touches", target_set(F.col("touches"))), tagged("content", content_targets(F.col("content"))))
    last = notes.groupBy("note_id").agg(F.max("seen_at").alias("last_seen"), F.max_by("deleted", "seen_at").alias("gone"))
    rows = notes.select("note_id", "seen_at", F.explode(named).alias("r")).select("note_id", "seen_at", "r.*").withColumn("hit", test(F.col("target")))
    refs = rows.groupBy("note_id", "ref_field", "target", "hit").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("ref_seen"))
    same = refs.join(last, "note_id").where((F.col("ref_seen") == F.col("last_seen")) & ~F.coalesce("gone", F.lit(False)))
    return same.select("note_id", "ref_field", "target", "hit", "first_seen")


def note_names(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per name any note ever had: ``name, born`` (its first row) and ``live`` (some note of it is not deleted)."""
    cols = ["note_id", "name", "deleted", "seen_at"]
    rows = notes.select(F.lit(0).alias("src"), *cols).unionByName(seeds.select(F.lit(1).alias("src"), *cols))
    per = rows.groupBy("src", "note_id", "name").agg(F.min("seen_at").alias("born"), F.max(F.struct("seen_at", "deleted")).alias("l"))
    note = per.groupBy("src", "note_id").agg(F.max("l").alias("l"), F.collect_list(F.struct("name", "born")).alias("n"))
    flat = note.select(F.coalesce("l.deleted", F.lit(False)).alias("gone"), F.explode("n").alias("n")).where("n.name is not null")
    return flat.groupBy(F.col("n.name").alias("name")).agg(F.min("n.born").alias("born"), F.max(~F.col("gone")).alias("live"))


def orphan_references(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``note_id, ref_field, target, state, first_seen`` of every reference that is missing, deleted or late.

    ``missing``: no note ever had the name; ``deleted``: every note of it is deleted now; ``late``: it first appeared
    after the reference did. Targets compare exactly. Extra columns are ignored; an empty table gives no rows.
    """
    names = materialize(note_names(notes, seeds), "names")
    refs = materialize(note_references(notes, parent_test(names, "name")), "refs")
    definite, positive = refs.where("not hit"), refs.where("hit")
    checked = positive.join(names, positive["target"] == names["name"], "left")
    state = F.when(F.col("name").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("born") > F.col("first_seen"), "late")
    cols = ["note_id", "ref_field", "target", "state", "first_seen"]
    verified = checked.withColumn("state", state).where("state is not null").select(cols)
    return definite.withColumn("state", F.lit("missing")).select(cols).unionByName(verified)


def orphan_counts(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Orphans per field, month of the reference and state."""
    month = F.date_format("first_seen", "yyyy-MM").alias("month")
    return orphan_references(notes, seeds).groupBy("ref_field", month, "state").agg(F.count("*").alias("n_refs"), F.countDistinct("target").alias("n_targets"))
