"""SpotSigs fingerprints in DataFrame functions: chains of content words after common-word anchors, as sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import block_of, materialize, text_bytes

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an is was are be of and to in that it for on with as by this at from or not he she they we you "
    "der die das den dem des und ist ein eine einer nicht von zu mit auf für im als auch sich "
    "le la les un une du et est que qui dans pour pas sur au aux il elle nous vous "
    "el los las de y en es por con para no se lo su al una del"
).split()
CHAIN, BLOCK_BYTES = 2, 16_000_000
#: Sets whose sizes differ by more than this ratio can't be similar.
SIMILARITY = 0.8


def with_signatures(df: DataFrame, texts: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """Adds a sorted array of distinct signatures for each text column: texts is {column: new column}.

    A signature is the hash of an anchor and the next `chain` content words after it; anchors between
    them are passed over. A text without any gets the hashes of its words, one without words none; null is empty.
    """
    out = df
    for text, new in texts.items():
        # Each array is a column of its own before a lambda reads it, so it is computed once a row.
        words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
        out = out.withColumn(f"_w_{new}", words)
        placed = F.transform(f"_w_{new}", lambda t, i: F.struct(i.alias("i"), t.alias("t")))
        out = out.withColumn(f"_c_{new}", F.filter(placed, lambda x: ~x["t"].isin(*ANCHORS)))
        content = F.col(f"_c_{new}")
        n = F.size(content)
        before = F.concat(F.array(F.lit(-1)), F.transform(content, lambda x: x["i"]))
        links = F.zip_with(F.slice(before, F.lit(1), n), content, lambda p, x: F.struct((p + 2).alias("lo"), (x["i"] - p - 1).alias("k"), F.array(x["t"]).alias("c")))
        for step in range(1, chain):
            ahead = F.slice(content, F.lit(step + 1), F.greatest(n, F.lit(1)))
            links = F.zip_with(links, ahead, lambda s, x: F.struct(s["lo"].alias("lo"), s["k"].alias("k"), F.concat(s["c"], F.array(x["t"])).alias("c")))
        whole = F.filter(links, lambda s: (s["k"] > 0) & s["c"].isNotNull() & ~F.exists(s["c"], lambda t: t.isNull()))
        found = F.flatten(F.transform(whole, lambda s: F.transform(F.slice(F.col(f"_w_{new}"), s["lo"], s["k"]), lambda a: F.xxhash64(a, s["c"]))))
        out = out.withColumn(f"_s_{new}", found)
        plain = F.when(F.size(f"_s_{new}") > 0, F.col(f"_s_{new}")).otherwise(F.transform(f"_w_{new}", lambda t: F.xxhash64(t)))
        out = out.withColumn(new, F.array_sort(F.array_distinct(plain))).drop(f"_w_{new}", f"_c_{new}", f"_s_{new}")
    return out


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 where their sizes alone keep it below `least`. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * least), F.lit(0.0)).otherwise(exact)


def length_partition(sig: Column, similarity: float = SIMILARITY) -> Column:
    """Sets in the same or in neighbouring partitions can be similar, no others."""
    return F.floor(F.log(F.greatest(F.size(sig), F.lit(1)).cast("double")) / math.log(1 / similarity)).cast("int")


def text_form(sig: Column) -> Column:
    """The set as lowercase hex, sixteen digits a signature, ascending by signed value."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def similar_sets(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, likeness): pairs of distinct signature sets, as fingerprints, at least `similarity` alike; a < b.

    Equal sets are one. A set of size n meets, in its own length partition and the next, those that share
    one of its n - ceil(similarity * n) + 1 rarest signatures, then sizes prune and Jaccard decides. Rarest-first
    keeps a signature that a third of the sets share out of the prefixes, unless sets have little else.
    """
    # Written before it is filtered: a filter would be pushed below the signatures and compute them again.
    made = materialize(with_signatures(docs.select("text"), {"text": "sig"}).select("sig").distinct(), "signatures")
    sets = made.where(F.size("sig") > 0).withColumn("id", text_form(F.col("sig")))
    sets = materialize(sets.withColumn("part", length_partition(F.col("sig"), similarity)), "sets")
    spread = sets.select("id", "part", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    counts = spread.groupBy("s").agg(F.count("*").alias("df"))
    ranked = spread.join(counts, "s").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "s")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).select("id", "part", "n", "s")
    left = prefix.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    met = left.alias("x").join(prefix.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") != F.col("y.id")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity))
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    judged = pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return judged.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), similarity).alias("likeness")).where(F.col("likeness") >= similarity)


def _ordered_blocks(docs: DataFrame, blocks: int) -> tuple[Column, DataFrame]:
    """(block, firsts): the block of each row of docs (doc_id, h, dealt, text), ascending with doc_id, and (doc_id, h, block): the first row after each block, by the block that needs it.

    Blocks are ranges of doc_id. Where one id, or null, fills several, its rows go by `dealt` into that many blocks of their own,
    before the others of the range; so no block grows with the rows of one id, nor with equal rows. After the last row comes the first.
    """
    keys = docs.select("doc_id")
    steps = [i / blocks for i in range(1, blocks)]
    stat = keys.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", F.array(*map(F.lit, steps or [0.5])), F.lit(max(10_000, 20 * blocks))).alias("q")).first()
    cuts = (stat["q"] or []) if steps else []
    bounds = sorted(set(cuts))
    often = {x: cuts.count(x) for x in bounds if cuts.count(x) > 1}
    nulls = -(-(stat["n"] - stat["known"]) * blocks // max(1, stat["n"]))
    spread = F.lit(0).cast("int")
    for x, parts in often.items():
        spread = F.when(F.col("doc_id") == F.lit(x), F.pmod("dealt", F.lit(parts)).cast("int")).otherwise(spread)
    home = block_of(F.col("doc_id"), bounds)
    if often:
        # The others of a range that begins with such an id stand behind its parts.
        parts = F.create_map(*[F.lit(v) for x, n in often.items() for v in (bounds.index(x) + 1, n)])
        spread = F.when(F.col("doc_id").isin(*often), spread).otherwise(F.coalesce(parts[home.cast("int")], F.lit(0)))
    place = F.when(F.col("doc_id").isNull(), F.pmod("dealt", F.lit(max(1, nulls))) - max(1, nulls)).otherwise(home.cast("long") * F.lit(blocks + 1) + spread).cast("long")
    found = docs.select("doc_id", "h", place.alias("block")).groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("k")).orderBy("block").collect()  # a row a block
    rows = [(found[(i + 1) % len(found)]["k"]["doc_id"], found[(i + 1) % len(found)]["k"]["h"], r["block"]) for i, r in enumerate(found)]
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("h long, block long")])
    return place, docs.sparkSession.createDataFrame(rows, schema)


def fingerprint_and_edit(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document's fingerprint and that of its edited text, whose last quarter is the next document's beginning.

    The next document follows by doc_id (nulls first; rows with one doc_id in an order of their own); the first follows the last.
    Beyond 4,096 blocks they grow: a block is a sorted stream that spills, of which two rows are held. Rows go to blocks in that order; a block also gets the first document of the next, so one
    shuffle serves and no window spans the table. Null texts are empty. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("dealt", F.xxhash64("h", F.monotonically_increasing_id()))
    spark = docs.sparkSession
    blocks = min(4096, max(-(-text_bytes(docs) // block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place, firsts = _ordered_blocks(docs, blocks)
    after = docs.join(F.broadcast(firsts.withColumnsRenamed({"doc_id": "id", "h": "k"})), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")))  # a row a block
    ghosts = after.groupBy("block").agg(F.min("text").alias("text"), F.first("doc_id", ignorenulls=False).alias("doc_id"), F.first("h").alias("h")).select("doc_id", "text", "h", "block", F.lit(1).alias("ghost"))
    sent = docs.withColumn("block", place).withColumn("ghost", F.lit(0)).select("doc_id", "text", "h", "block", "ghost").unionByName(ghosts)
    dealt = with_signatures(sent.repartition("block"), {"text": "sig"})
    after = Window.partitionBy("block").orderBy("ghost", "doc_id", "h", "text")
    held = dealt.withColumn("next", F.lead("text").over(after)).withColumn("next_sig", F.lead("sig").over(after)).where("ghost = 0")
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = held.withColumn("n", n).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k))).drop("text", "next")
    both = with_signatures(edited, {"edited": "edited_sig"})
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("sig")).alias("fingerprint"),
        text_form(F.col("edited_sig")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        pruned_jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"),
        length_partition(F.col("sig")).alias("length_partition"),
    )
