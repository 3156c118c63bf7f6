"""Encoding of a corpus with a public byte-level BPE vocabulary, inside Spark's expressions.

The text is cut into words by the vocabulary's pattern. A higher-order function folds ranked merges
over a word's array of bytes, looking pairs up in a rank map that is a literal of the plan. The words
that the corpus uses most are encoded once each, and their ids become a second literal; any other
word is encoded where it stands. So texts are never shuffled, and the plan is the same at every size.
Decoding concatenates the pieces of bytes that the ids stand for.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: fixed value: the vocabulary's pattern of words, with white space as Unicode defines it
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
RANK_BUCKETS = 1 << 16
#: Bits of an id in a packed merge: three ids fill a BIGINT.
ID_BITS = 21
#: How many of the most frequent words, of at most how many bytes, have their ids as a literal. This only
#: saves work: other words give the same ids where they stand.
LITERAL_WORDS, LITERAL_BYTES = 100_000, 48


def vocabulary_path(name: str = BYTE_BPE_50K, folder: str | None = None) -> str:
    """Where the vocabulary lies: ``folder``, else PLAYLEDGER_TOKENIZERS, else the usual folder."""
    return os.path.join(folder or os.environ.get("PLAYLEDGER_TOKENIZERS", TOKENIZERS), name)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Piece of bytes -> id; ids are ranks, the lower is merged first."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def merges(path: str) -> list[tuple[int, int, int]]:
    """(left id, right id, id) of each piece longer than a byte: the pair that it is merged from.

    The pair is what the merges of lower rank leave of the piece.
    """
    ranks = vocabulary(path)
    found = []
    for piece, rank in ranks.items():
        if len(piece) == 1:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found.append((ranks[parts[0]], ranks[parts[1]], rank))
    return found


def _literal(value: object, kind: str) -> Column:
    """A nested literal: parsed once when the plan is optimized."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


@lru_cache(maxsize=4)
def _rank_buckets(path: str) -> list[list[int]]:
    buckets: list[list[int]] = [[] for _ in range(RANK_BUCKETS)]
    if max(vocabulary(path).values()) >> ID_BITS:
        raise ValueError(f"ids of more than {ID_BITS} bits")
    for a, b, c in merges(path):
        buckets[(a * 31_321 + b * 7_919) % RANK_BUCKETS].append((a << 2 * ID_BITS) | (b << ID_BITS) | c)
    return buckets


def _rank(buckets: Column, a: Column, b: Column) -> Column:
    """The id that the pair of ids merges to, or null."""
    bucket = F.get(buckets, F.pmod(a * 31_321 + b * 7_919, F.lit(RANK_BUCKETS)))
    key = F.shiftleft(a, ID_BITS).bitwiseOR(b)
    return F.get(F.filter(bucket, lambda e: F.shiftright(e, ID_BITS) == key), F.lit(0)).bitwiseAND(F.lit((1 << ID_BITS) - 1))


def encode_word(word: Column, path: str) -> Column:
    """The ids of one word as ARRAY<BIGINT>: ranked merges folded over its bytes.

    Each step merges all places of the pair with the lowest rank, from left to right without
    overlap. This gives the same ids as one place at a time: a merge makes only pairs that rank
    behind it. Once no pair has a rank the remaining steps pass the ids on.
    """
    ranks = vocabulary(path)
    of_byte = _literal([ranks[bytes([i])] for i in range(256)], "array<bigint>")
    pairs = _literal(_rank_buckets(path), "array<array<bigint>>")
    two_digits = F.array_remove(F.split(F.hex(F.encode(word, "UTF-8")), r"(?<=\G[0-9A-F]{2})"), "")
    start = F.transform(two_digits, lambda x: F.get(of_byte, F.conv(x, 16, 10).cast("int")))
    state = F.struct(start.alias("ids"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        def merged(found: Column) -> Column:
            """found: one struct of the ranks of the pairs of acc, and the lowest."""
            marks = F.split(F.replace(F.array_join(F.transform(found["ranks"], lambda r: F.when(r == found["low"], "1").otherwise("0")), ""), F.lit("11"), F.lit("12")), "")
            placed = F.transform(
                F.arrays_zip(acc["ids"].alias("id"), F.concat(marks, F.array(F.lit("0"))).alias("here"), F.concat(F.array(F.lit("0")), marks).alias("left")),
                lambda x: F.when(x["left"] == "1", F.lit(-1).cast("bigint")).when(x["here"] == "1", found["low"]).otherwise(x["id"]),
            )
            return F.filter(placed, lambda x: x >= 0)

        def applied(ranks: Column) -> Column:
            found = F.struct(ranks.alias("ranks"), F.array_min(ranks).alias("low"))
            return F.get(F.transform(F.array(found), lambda f: F.when(f["low"].isNull(), F.struct(acc["ids"].alias("ids"), F.lit(True).alias("done"))).otherwise(F.struct(merged(f).alias("ids"), F.lit(False).alias("done")))), F.lit(0))

        n = F.size(acc["ids"])
        next_ids = F.slice(acc["ids"], 2, n)
        looked_up = F.zip_with(F.slice(acc["ids"], 1, n - 1), next_ids, lambda a, b: _rank(pairs, a, b))
        return F.when(acc["done"] | (n < 2), F.struct(acc["ids"].alias("ids"), F.lit(True).alias("done"))).otherwise(F.get(F.transform(F.array(looked_up), applied), F.lit(0)))

    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    return F.aggregate(steps, state, step, lambda acc: acc["ids"])


def words(text: Column) -> Column:
    """The words of a text; of a null or empty text none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def frequent_words(texts: DataFrame, text: str, path: str, most: int) -> list[tuple[str, list[int]]]:
    """(word, ids) of the ``most`` most frequent words of at most LITERAL_BYTES bytes, counted over all
    texts, each encoded once; at most ``most`` rows come to the driver."""
    found = texts.select(F.explode(words(F.col(text))).alias("word")).where(F.octet_length("word") <= LITERAL_BYTES).groupBy("word").agg(F.count("*").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(most).select("word")
    spread = top.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, 8))
    return [(r.word, list(r.ids)) for r in spread.select("word", encode_word(F.col("word"), path).cast("array<int>").alias("ids")).collect()]


def _placed(texts: DataFrame, text: str, path: str, most: int, value: Callable[[list[int]], object], kind: str, other: Callable[[Column], Column]) -> Column:
    """An array with what ``value`` makes of the ids of each word of the text: looked up in the literal,
    else made by ``other`` of the word."""
    known = frequent_words(texts, text, path, most) if most else []
    size = max(1024, 1 << (2 * len(known)).bit_length())
    table: list[list[dict]] = [[] for _ in range(size)]
    for word, own in known:
        # Spark's xxhash64, whose seed is 42; size is a power of 2
        table[xxhash.xxh64_intdigest(word.encode(), seed=42) & (size - 1)].append({"w": word, "v": value(own)})
    literal = _literal(table, f"array<array<struct<w:string,v:{kind}>>>")

    def of(w: Column) -> Column:
        there = F.get(F.filter(F.get(literal, F.pmod(F.xxhash64(w), F.lit(size)).cast("int")), lambda e: e["w"] == w), F.lit(0))["v"]
        return F.coalesce(there, other(w).cast(kind))

    return F.transform(words(F.col(text)), of)


def encode_column(texts: DataFrame, text: str, ids: str, *, path: str | None = None, most: int = LITERAL_WORDS) -> DataFrame:
    """texts with ``ids`` ARRAY<INT>: the ids of ``text`` without special tokens.

    A null and an empty text give an empty list. Strings that look like special tokens are ordinary
    text. Other columns stay; one named ``ids`` is replaced. The same for each of repeated rows.
    """
    path = path or vocabulary_path()
    return texts.withColumn(ids, F.flatten(_placed(texts, text, path, most, list, "array<int>", lambda w: encode_word(w, path))))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: their pieces' bytes one after the other, read as UTF-8.

    Ids outside the vocabulary stand for no bytes; a null list gives null.
    """
    ranks = vocabulary(path or vocabulary_path())
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece.hex()
    pieces = _literal(by_id, "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def token_counts(texts: DataFrame, text: str, *, key: str, path: str | None = None, most: int = LITERAL_WORDS) -> DataFrame:
    """``key`` and n_tokens of each text; the ids themselves are never put together."""
    path = path or vocabulary_path()
    each = _placed(texts, text, path, most, len, "int", lambda w: F.size(encode_word(w, path)))
    return texts.select(key, F.aggregate(each, F.lit(0), lambda a, b: a + b).alias("n_tokens"))
