"""Hashed lexical embeddings, canonical hashes and keyed digests, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.tables import ship

#: The personal name of the hash, our own: vectors have other places and signs than those of another name, and the same inner products but for collisions.
PERSON = b"basalt-v1"
#: Labels of features, weights of letter triples and word pairs, letters of a word from which it has triples, the word of an empty text.
WORD, LETTERS, WORDS, TRIPLE, PAIR, LONG, EMPTY = "word:", "char:", "bigram:", 0.15, 0.5, 4, "<empty>"
#: Words whose hashes, and texts whose features, a worker holds at once; a longer text alone.
HELD_WORDS, HELD_TEXTS = 1_000_000, 256
#: Words that carry no feature unless a text has nothing else.
STOP = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "between", "both", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have",
    "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no", "not", "of", "on", "or", "our", "ours", "she", "so", "some", "such", "than", "that", "the",
    "their", "theirs", "them", "then", "there", "these", "they", "this", "those", "to", "too", "up", "us", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would",
    "you", "your", "yours",
)


def _with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds _words: a text's words in their order, of which those without a feature are left out if there are others. Steps are columns of their own, so each is computed once a row."""
    whole = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    found = F.array_remove(F.split(whole, r"[^\p{L}\p{N}_'-]+"), "")
    every = F.when(F.size(found) > 0, found).otherwise(F.array(F.when(whole == "", EMPTY).otherwise(whole)))
    rows = df.withColumn("_every", every).withColumn("_telling", F.filter("_every", lambda w: ~w.isin(*STOP)))
    return rows.withColumn("_words", F.when(F.size("_telling") > 0, F.col("_telling")).otherwise(F.col("_every"))).drop("_every", "_telling")


def with_lexical_features(df: DataFrame, text: str, out: str = "features") -> DataFrame:
    """Adds an array of (name, weight): a text's distinct words by 1 + ln of their count, the letter triples of its distinct longer words, and the neighbours among its words.

    Steps are columns of their own, so each is computed once a row.
    """

    def feature(kind: str, name: Column, weight: Column) -> Column:
        return F.struct(F.concat(F.lit(kind), name).alias("name"), weight.cast("double").alias("weight"))

    rows = _with_words(df, text).withColumn("_sorted", F.array_sort("_words"))
    # In sorted order a word's count is the distance from its first place to the next word's; the end closes the last one.
    starts = F.filter(F.transform("_sorted", lambda w, i: F.when((i == 0) | (w != F.get(F.col("_sorted"), F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts).withColumn("_ends", F.array_append(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts"), F.lit(1))), F.size("_sorted")))
    counted = F.zip_with("_starts", "_ends", lambda i, j: feature(WORD, F.get(F.col("_sorted"), i), 1 + F.log((j - i).cast("double"))))
    long = F.transform(F.filter(F.array_distinct("_sorted"), lambda w: F.length(w) >= LONG), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    triples = F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: feature(LETTERS, F.substring(w, i, F.lit(3)), F.lit(TRIPLE)))))
    after = F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1)))
    pairs = F.filter(F.zip_with("_words", after, lambda x, y: F.when(y.isNotNull(), feature(WORDS, F.concat(x, F.lit(":"), y), F.lit(PAIR)))), lambda p: p.isNotNull())
    none = F.array().cast("array<struct<name: string, weight: double>>")
    made = rows.withColumn("_c", counted).withColumn("_t", triples).withColumn("_p", pairs)
    return made.withColumn(out, F.when(F.size("_words") == 0, none).otherwise(F.concat("_c", "_t", "_p"))).drop("_words", "_sorted", "_starts", "_ends", "_c", "_t", "_p")


def _places(names, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the sign of each of many features, an iterable of bytes."""
    digest = np.fromiter((int.from_bytes(hashlib.blake2b(x, digest_size=8, person=PERSON).digest(), "big") for x in names), np.uint64)
    return (digest % np.uint64(size)).astype(np.int64), np.where(digest >> np.uint64(63), 1.0, -1.0)


def _embedded(words: pa.ListArray, size: int) -> np.ndarray:
    """The vectors of texts by their words: with_lexical_features' names and weights, each distinct word, letter triple and pair of neighbours hashed once."""
    counts = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    code, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    raw = [w.encode() for w in kinds]
    row = np.repeat(np.arange(len(words)), counts)
    word_place, word_sign = _places((WORD.encode() + w for w in raw), size)
    # The triples of all distinct words lie in a row.
    many = np.array([len(w) if len(w) >= LONG else 0 for w in kinds], np.int64)
    first = np.cumsum(many) - many
    known: dict[str, int] = {}
    number = np.array([known.setdefault(f"^{w}$"[i : i + 3], len(known)) for w in kinds if len(w) >= LONG for i in range(len(w))], np.int64)
    place, sign = _places(((LETTERS + t).encode() for t in known), size)
    triple_place, triple_sign = place[number], sign[number]
    together = np.flatnonzero(row[1:] == row[:-1])
    number, pairs = pd.factorize(code[together] * len(kinds) + code[together + 1])
    left, right = np.divmod(pairs, max(1, len(kinds)))
    place, sign = _places((b"%b%b:%b" % (WORDS.encode(), raw[x], raw[y]) for x, y in zip(left.tolist(), right.tolist(), strict=True)), size)
    pair_row, pair_place, pair_sign = row[together], place[number], sign[number]
    out = np.zeros((len(words), size), np.float32)
    for low in range(0, len(words), HELD_TEXTS):
        high = min(low + HELD_TEXTS, len(words))
        mine = slice(*np.searchsorted(row, [low, high]))
        # Distinct words of each text, by 1 + ln of their count, with their triples; neighbours as often as they come.
        own, n = np.unique((row[mine] - low) * len(kinds) + code[mine], return_counts=True)
        own_row, own_word = np.divmod(own, max(1, len(kinds)))
        each = many[own_word]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first[own_word], each)
        near = slice(*np.searchsorted(pair_row, [low, high]))
        at = [own_row * size + word_place[own_word], np.repeat(own_row, each) * size + triple_place[inner], (pair_row[near] - low) * size + pair_place[near]]
        add = [word_sign[own_word] * (1 + np.log(n)), triple_sign[inner] * TRIPLE, pair_sign[near] * PAIR]
        v = np.bincount(np.concatenate(at), np.concatenate(add), (high - low) * size).reshape(-1, size)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        out[low:high] = v / np.where(length == 0, 1, length)
    return out


def with_lexical_embedding(df: DataFrame, text: str, out: str, size: int = 1536) -> DataFrame:
    """Adds a vector: each feature of a text (with_lexical_features) goes to one of `size` places with a sign, both from its BLAKE2b hash. It has length one.

    Spark takes texts apart into words; Python makes a batch's features from its distinct words and pairs, some texts at a time, and adds up.
    """

    @F.arrow_udf("array<float>")
    def hashed(words: pa.Array) -> pa.Array:
        counts = np.diff(words.offsets.to_numpy())
        parts = np.cumsum(counts) // HELD_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(words)] if len(words) else []
        made = [pa.array(_embedded(words.slice(a, b - a), size).ravel()) for a, b in zip(cuts, cuts[1:], strict=False)]
        flat = pa.concat_arrays(made) if made else pa.array([], pa.float32())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * size, pa.int32()), flat)

    ship(df.sparkSession)
    return _with_words(df, text).withColumn(out, hashed(F.col("_words"))).drop("_words")


def fold(c: Column) -> Column:
    """NFKC, case folded, white space runs one blank."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return run(c)


def canonical_hash(c: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys, no blanks, and signs beyond ASCII kept."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            return None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

        return texts.map(one)

    return run(c)


def name_uuid(c: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else str(uuid.uuid5(namespace, n)))

    return run(c)


def signature(body: Column, timestamp: Column, secret: str) -> Column:
    """v1= and the HMAC-SHA256 of the timestamp, a dot and the body."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, times: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([None if b is None or t is None else "v1=" + hmac.new(key, f"{t}.{b}".encode(), hashlib.sha256).hexdigest() for b, t in zip(bodies, times, strict=True)])

    return run(body, timestamp.cast("string"))


#: Names of fields whose values are hidden, whole names in any case, and what stands in their place.
SECRET = re.compile(r"(?:api[_-]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization|cookie|password|secret|credential)", re.IGNORECASE)
HIDDEN = "[REDACTED]"


def redact(c: Column) -> Column:
    """A JSON text in which the values of secret fields, however deep, are replaced."""

    def clean(x):
        if isinstance(x, dict):
            return {k: HIDDEN if SECRET.fullmatch(k) else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run(c)
