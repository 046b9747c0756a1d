"""Document fingerprints by winnowing, in SQL functions only.

The k-grams are of words: the hash of words i to i+k-1 is a polynomial h(i)*f(0) + ... +
h(i+k-1)*f(k-1) of the words' hashes, whose factors are powers of one number. In every
window of w successive k-grams the least hash is chosen, the rightmost of equals, and its
position is kept. So two texts that share w + k - 1 successive words share a fingerprint entry,
and each entry says where.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions have 28 bits and hashes 35, so that one long holds an entry.
POSITION = 1 << 28
ROWS_PER_BLOCK = 2048
MOST_BLOCKS = 10_000


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; no word gives an empty array."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def entry_columns(df: DataFrame, text: str, name: str, k: int, w: int) -> DataFrame:
    """``df`` with an array column ``name`` of the entries chosen from column ``text``, in order of position.

    An entry is (hash << 28) + 2^28 - 1 - position, so the least entry of a window is that of the
    least hash, and of the rightmost of equals. A text of fewer than ``k`` words is one k-gram.
    """
    h, grams, fours, least = (f"_{name}_{x}" for x in ("h", "grams", "fours", "least"))
    # Word hashes of 29 bits under factors below 2^31 keep a sum of up to 8 terms inside a long.
    factors = [pow(0x5DEECE6D, j + 1, 2_147_483_647) for j in range(k)][::-1]
    df = df.withColumn(h, F.transform(words_of(F.col(text)), lambda x: F.shiftrightunsigned(F.xxhash64(x), 35)))
    n = F.size(h)

    def gram(i: Column) -> Column:
        value = reduce(Column.__add__, [F.coalesce(F.get(F.col(h), i + j), F.lit(0)) * factors[j] for j in range(k)])
        mixed = F.shiftrightunsigned(F.xxhash64(value), 29)
        return F.shiftleft(mixed, 28) + (POSITION - 1) - i.cast("long")

    many = F.greatest(n - k, F.lit(0))
    df = df.withColumn(grams, F.when(n > 0, F.transform(F.sequence(F.lit(0), many), gram)).otherwise(F.array().cast("array<long>")))
    size = F.size(grams)
    # The window's minimum is taken in two steps: of four neighbours, then of four such minima.
    df = df.withColumn(
        fours, F.transform(F.col(grams), lambda x, i: F.least(x, *[F.coalesce(F.get(F.col(grams), i + j), x) for j in range(1, w // 4)]))
    )
    steps = [w // 4 * j for j in range(4)]
    df = df.withColumn(
        least,
        F.when(
            F.size(grams) > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(size - w, F.lit(0))),
                lambda i: F.least(*[F.get(F.col(fours), i + j) for j in steps]),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    return df.withColumn(name, F.array_distinct(F.col(least))).drop(h, grams, fours, least)


def hashes(entries: Column) -> Column:
    """The distinct hashes of entries."""
    return F.array_distinct(F.transform(entries, lambda x: F.shiftrightunsigned(x, 28)))


def shown(entries: Column) -> Column:
    """``hash@position`` of each entry, hash in hexadecimal, joined by blanks."""
    return F.array_join(
        F.transform(
            entries,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftrightunsigned(x, 28))), F.lit("@"),
                (F.lit(POSITION - 1) - x.bitwiseAND(F.lit(POSITION - 1))).cast("string"),
            ),
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard's similarity of two sets of hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared.cast("double") / union)


def in_id_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (id long, text) in blocks of successive ids, each with its next block's first rows.

    Adds block and follows (true for those guests, which come last). The bounds are ids of the
    table, from one pass over the ids; a table of any size has at most ``MOST_BLOCKS``, and the
    last block is followed by the first row.
    """
    count = docs.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, min(MOST_BLOCKS, count // ROWS_PER_BLOCK))
    at = [i / blocks for i in range(blocks)]
    found = docs.agg(F.percentile_approx("id", at, 20 * blocks).alias("b"), F.min("id").alias("low")).first()
    bounds = sorted({*(found["b"] or []), *([found["low"]] if count else [])})
    if not bounds:
        return docs.withColumns({"block": F.lit(0), "follows": F.lit(False)})
    # A binary search written as two linear ones over about the root of the bounds.
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i: i + wide] for i in range(0, len(bounds), wide)]
    starts = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    coarse = F.size(F.filter(starts, lambda x: x <= F.col("id"))) - 1
    fine = F.size(F.filter(F.get(table, F.col("coarse")), lambda x: x <= F.col("id"))) - 1
    block = (F.col("coarse") * wide + fine).cast("int")
    own = docs.withColumn("coarse", coarse).withColumn("block", block)
    is_first = F.get(F.get(table, F.col("coarse")), F.col("block") - F.col("coarse") * wide) == F.col("id")
    before = F.when(F.col("block") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("block") - 1)

    def place(number: Column, follows: bool) -> Column:
        return F.struct(number.cast("int").alias("block"), F.lit(follows).alias("follows"))

    home = place(F.col("block"), False)
    places = F.when(is_first, F.array(home, place(before, True))).otherwise(F.array(home))
    return own.withColumn("place", F.explode(places)).select("id", "doc_id", "text", "place.block", "place.follows")


def winnowed(docs: DataFrame, k: int = 5, w: int = 16) -> DataFrame:
    """(doc_id, entries array<long>) of each row: the general form, without edits."""
    return entry_columns(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "entries", k, w).select("doc_id", "entries")


def fingerprint_edits(docs: DataFrame, k: int = 5, w: int = 16) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, by ascending doc_id, the first following the last. A null text is
    empty. A null doc_id comes first; rows of one doc_id are ordered by their text. A fingerprint
    is empty if the text has no word. Other columns are ignored; an empty table gives no rows.
    ``w`` is a multiple of 4. Texts are shuffled once, in blocks of successive ids; no Python runs.
    """
    lowest = -(1 << 63)
    plain = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = in_id_blocks(plain)
    order = Window.partitionBy("block").orderBy("follows", "id", "text")
    paired = dealt.withColumn("next_text", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    made = entry_columns(paired.withColumn("edited", edited), "text", "own", k, w)
    made = entry_columns(made, "edited", "other", k, w)
    seen = made.withColumn("set", hashes(F.col("own"))).select(
        "block", "follows", "id", "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"), "set", hashes(F.col("other")).alias("edited_set"),
    )
    following = seen.withColumn("next_set", F.lead("set").over(order)).where("not follows")
    return following.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("set"), F.coalesce("next_set", "set")).alias("near_next"),
    )
