"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced
from sortwell.llm.keep import LOOKUP_ROWS, one_of_each
from sortwell.operators.components import connected_components
from sortwell.operators.spread import with_group
from sortwell.session import evenly, map_arrow, settle, table

WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
#: Fingerprints that share a segment's value before it is looked up by 48 bits.
HOT = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles of ``text``, as a signed integer; 0 without words."""
    seq = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not seq:
        return 0
    if len(seq) <= words:
        shingles = [b" ".join(seq)]
    else:
        shingles = [b" ".join(s) for s in zip(*(seq[i:] for i in range(words)), strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64, len(shingles)).astype(">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def _text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, key, fp`` of every row; ``key`` is a hash of the text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["id", "key", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_key(F.col(text_col)).alias("key")), run, f"id {id_type}, key long, fp long")


def _segment(fp: Column, n: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * n).bitwiseAND(F.lit(0xFFFFFFFF))


def _sub(half: Column, k: int) -> Column:
    """One of the two 16-bit parts of a half."""
    return F.shiftrightunsigned(half, 16 * k).bitwiseAND(F.lit(0xFFFF))


def _candidates(fps: DataFrame, radius: int = 1) -> DataFrame:
    """``pfp, proot, fp, root``: the pairs of fingerprints whose full distance has to be verified, each once.

    Of three differing bits, one of the two 32-bit segments has at most one. So each
    segment goes into a table by its value, and each fingerprint looks up the Hamming
    ball of radius one around its segment. From a ball of radius one only values with
    a bit more are looked up: of two segments at distance one, one has the bit and is
    found from the other. With ``radius`` 0 only pairs with an equal segment are found.

    A value that more than ``HOT`` fingerprints share is a table of its own: there, one of the
    two 16-bit parts of the other segment has at most one differing bit too, and is looked up
    with it. So a dense family is met by 48 bits, not by 32. A pair that both parts
    find is given by the first.
    """
    seg = F.array(*[F.struct(F.lit(n).alias("n"), _segment(F.col("fp"), n).alias("seg")) for n in range(2)])
    rows = fps.select("fp", "root", F.inline(seg)).select("n", "seg", "fp", "root")
    ball = F.array(F.col("seg"))
    if radius:
        ball = F.concat(ball, F.expr("transform(filter(sequence(0, 31), i -> getbit(seg, i) = 0), i -> seg | shiftleft(1L, i))"))
    probes = rows.select(F.col("n").alias("pn"), F.explode(ball).alias("at"), F.col("seg").alias("from_seg"), F.col("fp").alias("pfp"), F.col("root").alias("proot"))
    hot = settle(rows.groupBy("n", "seg").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > HOT).select(F.col("n").alias("hn"), F.col("seg").alias("hseg")), "hot")
    n_hot = hot.count()
    meets = (F.col("pn") == F.col("n")) & (F.col("at") == F.col("seg"))
    once = (F.col("at") != F.col("from_seg")) | (F.col("pfp") < F.col("fp"))
    if not n_hot:
        return probes.join(rows, meets & once).select("pfp", "proot", "fp", "root")
    side = F.broadcast(hot) if n_hot <= LOOKUP_ROWS else hot
    found = probes.join(rows.join(side, (F.col("n") == F.col("hn")) & (F.col("seg") == F.col("hseg")), "left_anti"), meets & once)

    other = lambda fp, n: F.when(n == 0, _segment(fp, 1)).otherwise(_segment(fp, 0))
    part = lambda half: F.array(*[F.struct(F.lit(k).alias("k"), _sub(half, k).alias("sub")) for k in range(2)])
    there = rows.join(side, (F.col("n") == F.col("hn")) & (F.col("seg") == F.col("hseg")), "left_semi").withColumn("half", other(F.col("fp"), F.col("n")))
    there = there.select("n", "seg", "fp", "root", "half", F.inline(part(F.col("half"))))
    into = probes.join(side, (F.col("pn") == F.col("hn")) & (F.col("at") == F.col("hseg")), "left_semi").withColumn("phalf", other(F.col("pfp"), F.col("pn")))
    into = into.select("*", F.inline(part(F.col("phalf")))).withColumnsRenamed({"k": "pk", "sub": "own"})
    # within one value a bit more is enough, between two values of a ball only one side looks
    around = F.expr("concat(array(own), transform(filter(sequence(0, 15), i -> at <> from_seg OR getbit(own, i) = 0), i -> own ^ shiftleft(1L, i)))")
    into = into.withColumn("sub_at", F.explode(around))
    first = (F.col("k") == 0) | (F.bit_count(_sub(F.col("half").bitwiseXOR(F.col("phalf")), 0)) > 1)
    single = (F.col("at") != F.col("from_seg")) | (F.col("sub_at") != F.col("own")) | (F.col("pfp") < F.col("fp"))
    dense = into.join(there, meets & (F.col("pk") == F.col("k")) & (F.col("sub_at") == F.col("sub")) & first & single)
    return found.select("pfp", "proot", "fp", "root").unionByName(dense.select("pfp", "proot", "fp", "root"))


def _matches(fps: DataFrame, radius: int = 1) -> DataFrame:
    """``pfp, fp``: pairs of distinct fingerprints at ``MAX_BITS`` or fewer differing bits, each from one side.

    ``fps`` has ``fp`` and ``root``, null or the group in which a fingerprint is known
    to be; pairs within a group are left out. See ``_candidates``.
    """
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))) <= MAX_BITS
    apart = F.coalesce(F.col("root") != F.col("proot"), F.lit(True))
    return _candidates(fps, radius).where(close & apart).select("pfp", "fp", "proot", "root")


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: all pairs of the distinct fingerprints ``fp`` that link."""
    found = _matches(fps.withColumn("root", F.lit(None).cast("long")))
    return found.select(F.least("fp", "pfp").alias("a"), F.greatest("fp", "pfp").alias("b"))


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """``fp, root`` of the distinct fingerprints ``fp``: the least fingerprint reachable by links.

    Links of a dense family are not written out. A first pass over equal segments keeps
    one partner of each fingerprint, which joins nearly all of a family; a second one
    over the whole balls looks for links between the groups so found, one for each pair
    of groups. Together they reach what all links reach.
    """
    fps = fps.select("fp")
    one = _matches(fps.withColumn("root", F.lit(None).cast("long")), 0).groupBy("pfp").agg(F.max("fp").alias("fp"))
    joined = fps.join(connected_components(one, "pfp", "fp"), F.col("fp") == F.col("node"), "left")
    first = settle(joined.select("fp", F.coalesce("component", "fp").alias("root")), "families")
    between = _matches(first).select(F.least("root", "proot").alias("a"), F.greatest("root", "proot").alias("b")).distinct()
    joined = first.join(connected_components(between), F.col("root") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("component", "root").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: ``id_col, fp, component_id``.

    ``component_id`` is the smallest id among all rows reachable by links. Rows with
    equal fingerprints are one node, so copies are never paired; membership is a join
    on the fingerprint between two written tables, where Spark can split a hot one.
    Null and empty texts have fingerprint 0 and are linked like any other; shorter
    texts than a shingle are hashed whole. A null id gets its component like others
    and is never a component's id unless all its ids are null. Repeated rows share a
    component. An empty table gives no rows; other columns are not read.
    """
    return _near_rows(docs, id_col, text_col, words).select(F.col("id").alias(id_col), "fp", "component_id")


def _near_rows(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``id, key, fp, root, component_id`` of every row; ``root`` names the component also where ids repeat."""
    rows = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = settle(fingerprint_groups(nodes), "roots")
    grouped = nodes.join(roots, "fp")
    least = settle(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = settle(roots.join(least, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, of its smallest id, with all its columns.

    Of several texts of that id the one with the least fingerprint stays, of repeated
    rows one; a null id stays only where all ids of a component are null. Null and
    empty texts are one component. Columns keep their names, also those used in here.
    An empty table gives no rows. See ``one_of_each`` for when texts are moved.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "key")
    rows = with_group(_near_rows(docs, id_col, text_col), ["root"], {"least": F.min(order)}, "id").where("group_n >= 2")
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("fp") == F.col("least.fp")) & (F.col("key") == F.col("least.key"))
    pairs = settle(rows.groupBy("id", "key", stays.alias("kept")).agg(F.count(F.lit(1)).alias("copies")), "pairs")
    pairs = pairs.withColumn("sketch", F.col("key"))
    return one_of_each(docs, id_col, text_col, _text_key, _text_key, pairs.where("NOT kept"), pairs.where("kept AND copies > 1"))


def op10_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(evenly(table(spark, sf_dir, "documents"))).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
