"""SimHash near-dedup by fuzzy Golay keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenalake.llm.common import hot_limit, materialise, row_key
from arenalake.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SEGMENTS, BITS = 4, 16
#: Fingerprints decoded in one task, about.
FINGERPRINTS = 20_000


def fingerprint(text: str | None, chunk: int = 1 << 15) -> int:
    """Unsigned SimHash of the 3-word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), chunk):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + chunk], last[at : at + chunk], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * votes > len(first), bitorder="little")
    return int(set_bits.view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY << (bit - 11))
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit segment (padded to 23 bits): its codeword index, and those of all words within one bit.

    The code is perfect: each of the 2048 syndromes belongs to one error of three bits or fewer.
    The index of a codeword is its upper 12 bits. The second table has a column for the word
    itself and one for each flipped bit; a segment has at most six different indices there.
    """
    bits = [1 << i for i in range(23)]
    errors = np.array([0] + bits + [a | b for i, a in enumerate(bits) for b in bits[:i]] + [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]])
    error_of = np.zeros(2048, np.int64)
    error_of[_syndromes(errors)] = errors
    words = np.arange(1 << BITS, dtype=np.int64)
    decode = lambda w: (w ^ error_of[_syndromes(w)]) >> 11
    return decode(words), np.stack([decode(words)] + [decode(words ^ (1 << b)) for b in range(BITS)], axis=1)


@F.pandas_udf(T.StructType().add("own", T.ArrayType(T.LongType())).add("near", T.ArrayType(T.LongType())))
def golay_keys(fps: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Keys of a fingerprint: segment i exactly, with the codeword index of segment i+1.

    own has the index of the segment itself; near has the indices of all segments within a bit.
    """
    index, around = golay_tables()
    for batch in fps:
        f = batch.to_numpy(np.int64).view(np.uint64)
        own, near = [], []
        for i in range(SEGMENTS):
            exact = ((f >> np.uint64(BITS * i)) & np.uint64(0xFFFF)).astype(np.int64)
            fuzzy = ((f >> np.uint64(BITS * ((i + 1) % SEGMENTS))) & np.uint64(0xFFFF)).astype(np.int64)
            head = (np.int64(i) << 40) | (exact << 12)
            own.append(head | index[fuzzy])
            near.append(head[:, None] | around[fuzzy])
        yield pd.DataFrame({"own": list(np.stack(own, 1)), "near": [np.unique(r) for r in np.concatenate(near, 1)]})


def link_fingerprints(distinct: DataFrame, rows: int = 0) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) at Hamming distance 3 or less.

    Three errors over four segments leave some segment i exact whose successor has one error at
    most: were it not so, each exact segment would need a successor with two or more errors of its
    own, and the errors run out. Then the successor's codeword index is among the other side's
    near keys, so joining near keys with own keys meets every link; the join condition
    verifies the distance, so only links leave it. A fingerprint has 43,744 neighbours at most.
    Of a key that many fingerprints own, the near side is dealt to parts and the owning side
    copied to each, so no task compares all of them. rows: about how many fingerprints there are.
    """
    # Decoding is work for its few bytes, so the number of tasks is named.
    spread = distinct.repartition(1 + (rows or distinct.count()) // FINGERPRINTS, "fp")
    keyed = spread.select("fp", golay_keys("fp").alias("k"))
    keyed = materialise(keyed.select("fp", "k.own", "k.near"), "golay")
    near = keyed.select(F.col("fp").alias("a"), F.explode("near").alias("key"))
    own = keyed.select(F.col("fp").alias("b"), F.explode("own").alias("key"))
    total = SEGMENTS * keyed.count()
    held = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_limit(total))
    hot = F.broadcast(materialise(held, "hot"))  # a thousand keys at most
    parts = F.coalesce(F.ceil(F.col("n") / hot_limit(total)), F.lit(1)).cast("int")
    near = near.join(hot, "key", "left").select("a", "key", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    own = own.join(hot, "key", "left").select("b", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return near.join(own, ["key", "part"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id, n_links.

    Documents with equal fingerprints form one class before anything is joined, so copies never
    meet in pairs. n_links counts the other classes linked directly. component_id is the smallest
    doc_id of the component; a null doc_id keeps its row and never names a component unless all
    are null. Null and blank texts have fingerprint zero and link like any other. Extra columns
    are ignored.
    """
    fps, of_class = _grouped(docs)
    return fps.join(of_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _grouped(docs: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, carried columns, fp), and the classes (fp, component, component_id, n_links)."""
    fps = materialise(docs.select("doc_id", *carried, fingerprint_udf(F.col("text")).alias("fp")), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = materialise(link_fingerprints(classes.select("fp"), fps.count()), "simhash-links")
    comps = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    grouped = classes.join(comps, classes.fp == comps.node, "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps, grouped.select("fp", "component").join(named, "component").join(degree, "fp", "left")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest by doc_id (null last), text hash and other columns' hash.

    Of equal rows one stays. Null and blank texts have fingerprint zero, so one of them stays. An
    empty table gives an empty table; a column of docs named like the working column is kept apart.
    """
    hashed = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]  # maps have no hash
    key = F.concat_ws("|", row_key(F.col("doc_id"), F.col("text")), F.hex(F.xxhash64(*hashed)))
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", key.alias("__key"))
    rows, of_class = _grouped(keyed, "__key")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__key")
    first = rows.join(of_class, "fp").groupBy("component").agg(F.min(place).alias("p")).select("p.__key")
    kept = keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select("__row.*")
