"""Mixing sources to target shares of all tokens, with a cap on repeats.

Every source gets a quota of tokens: its share of the total, or all its texts times the cap if that is less. Whole passes over a source take all its texts; the
last, partial pass takes a random permutation of the texts up to the quota. Output shards are filled by a splitting tree: the number of copies of
every source block is split between the two halves of the shards with multivariate hypergeometric draws, down to single shards, so that each shard holds an
exact random share of every block and no two shards share a copy. Within a shard the order is shuffled locally.

No window or task takes a whole source: texts are ordered within hash buckets of it, and only one row a bucket is summed over the source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import Scratch

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096  # hash buckets of a source: blocks of texts that the tree splits
FAN = 16  # shards or groups of shards into which one step of the tree splits a node


def source_name(c: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def _counter(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [sum(len(enc.encode_ordinary(part)) for part in _parts(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def _parts(text: str, size: int = 200_000) -> Iterator[str]:
    """Very long texts in parts that end at a blank where there is one, as the tokenizer's time grows faster than its input."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) with sources by their proper names; null and empty texts have no tokens. `pattern` belongs to the rank file `tokenizer`."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return docs.mapInArrow(_counter(tokenizer, pattern), "doc_id long, source string, tokens long")


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each listed source: its quota, what it can give, and whether it reaches its share. counts: (doc_id, source, tokens).

    The total is the tokens of all documents, those of unlisted sources too. Null shares count as 0, null caps as 1; a source listed twice counts with the sum of its
    shares and the larger cap.
    """
    per = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    want = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("key")).agg(
        F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    plan = want.join(per.withColumnRenamed("source", "key"), "key", "left").withColumn("total", F.lit(total).cast("long"))
    plan = plan.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("texts", F.coalesce("texts", F.lit(0)))
    plan = plan.withColumn("wanted", F.ceil(F.col("target_share") * F.col("total")).cast("long")).withColumn("available", F.col("tokens") * F.col("max_repeats"))
    return plan.withColumn("quota", F.least("wanted", "available")).withColumn("short", F.col("available") < F.col("target_share") * F.col("total"))


def split_tree(counts: np.ndarray, shards: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(shards, blocks): an exact random division of counts[block] copies among the shards, each shard getting as near as possible its weight (1 unless given).

    At every node the copies of the left half are a multivariate hypergeometric draw from those of the node.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)
    share = np.concatenate([[0], np.cumsum(np.ones(shards, np.int64) if weights is None else weights)]).tolist()

    def go(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (share[mid] - share[lo]) // (share[hi] - share[lo])
        left = _hypergeometric(rng, have, take)
        go(left, lo, mid)
        go(have - left, mid, hi)

    go(np.asarray(counts, np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """One multivariate hypergeometric draw, block after block, for totals of any size."""
    out, left = np.zeros_like(have), int(have.sum())
    for i, h in enumerate(have.tolist()):
        left -= h
        if take <= 0:
            break
        k = _draw(rng, h, left, take) if h else 0
        out[i], take = k, take - k
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` copies drawn from good + bad are good; the library's sampler ends at a billion."""
    return int(rng.hypergeometric(good, bad, take)) if good + bad < 1_000_000_000 else _inverted(rng, good, bad, take)


def _inverted(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """The same draw by inverting the distribution: its terms are summed over twelve deviations to either side of its peak, beyond which less lies than a double can tell."""
    n = good + bad
    low, high = max(0, take - bad), min(good, take)
    peak = min(max((take + 1) * (good + 1) // (n + 2), low), high)
    reach = int(12 * np.sqrt(take * (good / n) * (bad / n) * ((n - take) / (n - 1)))) + 12
    a, b = max(low, peak - reach), min(high, peak + reach)
    k = np.arange(a, b, dtype=float)
    step = np.log((good - k) * (take - k)) - np.log((k + 1) * (bad - take + k + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right").clip(max=b - a))


def _split_node(shards: int, seed: int):
    """One step of the tree for one node, the shards lo to hi: its blocks' copies go to at most FAN groups of neighbouring shards. A node holds one row a block."""

    def run(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values(["source", "bucket"], kind="stable")
        lo, hi = int(h.lo.iloc[0]), int(h.hi.iloc[0])
        edges = np.unique(np.linspace(lo, hi, min(FAN, hi - lo) + 1).astype(np.int64))
        tree = split_tree(h.n.to_numpy(), len(edges) - 1, hash((seed, lo, hi)) & 0x7FFFFFFF, np.diff(edges))
        child, block = np.nonzero(tree)
        return pd.DataFrame({"source": h.source.to_numpy()[block], "bucket": h.bucket.to_numpy()[block], "lo": edges[child], "hi": edges[child + 1], "n": tree[child, block]})

    return run


def shard_blocks(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, bucket, lo, n): copies of every block (source, bucket, n) in each shard `lo`, by levels of the splitting tree. The nodes of a level are split by
    different tasks; each holds BUCKETS rows a source of the targets at most, and nothing comes to the driver."""
    scratch, width = Scratch(blocks.sparkSession, "mix-tree"), shards
    nodes = blocks.select("source", "bucket", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "n")
    while width > 1:
        split = nodes.where("hi - lo > 1").groupBy("lo", "hi").applyInPandas(_split_node(shards, seed), "source string, bucket int, lo long, hi long, n long")
        nodes = scratch.keep(nodes.where("hi - lo = 1").unionByName(split))
        width = -(-width // FAN)
    return nodes.select("source", "bucket", "lo", "n")


def mixed_copies(counts: DataFrame, plan: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """(shard, place, source, doc_id, copy, tokens): every copy of every text in the mix, once.

    counts: (doc_id, source, tokens) with normalised sources; plan: see `mix_plan`. A source is passed over floor(quota / tokens) times in full, and
    once more up to the quota in random order; the last text taken may exceed it. Texts without tokens come with full passes only.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "mix")
    small = plan.select(F.col("key").alias("source"), F.col("quota"), F.col("tokens").alias("source_tokens"), "max_repeats").where("quota > 0")
    rows = counts.join(F.broadcast(small), "source")  # one row for each source of the targets, a table of fixed size
    h = F.xxhash64(F.lit(seed), "doc_id", "tokens")
    rows = scratch.keep(rows.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int")))
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(across), F.lit(0))).drop("t")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carry, ["source", "bucket"]).withColumn("start", F.col("before") + F.sum("tokens").over(within) - F.col("tokens"))
    full = F.floor(F.col("quota") / F.col("source_tokens"))
    part = (F.col("start") < F.col("quota") - full * F.col("source_tokens")).cast("long")
    copies = F.least(full + part, F.col("max_repeats").cast("long"))
    rows = scratch.keep(rows.withColumn("copies", copies).where("copies > 0").select("source", "bucket", "doc_id", "tokens", "copies", "h"))
    blocks = rows.groupBy("source", "bucket").agg(F.sum("copies").alias("n"))
    per_shard = shard_blocks(blocks, shards, seed)
    ends = per_shard.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("s"))
    # running ends of the shards within a block, and the shards
    so_far = F.aggregate("s", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x["n"])))
    ends = ends.select("source", "bucket", F.when(F.size("s") > 0, so_far).alias("ends"), F.transform("s", lambda x: x["lo"]).alias("shards"))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.withColumn("r", F.xxhash64("h", "copy", F.lit(seed + 1)))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("r", "doc_id", "copy"))
    each = each.withColumn("k", place).join(ends, ["source", "bucket"])
    shard = F.get("shards", F.size(F.filter("ends", lambda e: e < F.col("k")))).cast("int")
    return each.select(shard.alias("shard"), F.xxhash64("r", F.lit(seed + 2)).alias("place"), "source", "doc_id", "copy", "tokens")


def mix(documents: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """The copies of the mix, see `mixed_copies`: sort each shard by `place` to get its shuffled order."""
    counts = Scratch(documents.sparkSession, "mix-counts").keep(token_counts(documents, **how))
    return mixed_copies(counts, mix_plan(counts, targets), shards, seed)


def mix_report(documents: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """One row for each listed source: share wanted and reached, tokens, most repeats, and whether the cap keeps it short."""
    scratch = Scratch(documents.sparkSession, "mix-counts")
    counts = scratch.keep(token_counts(documents, **how))
    plan = mix_plan(counts, targets)
    used = mixed_copies(counts, plan, shards, seed).groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("mixed"), F.max("copy").alias("repeats"))
    out = plan.join(used, "key", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    total = F.sum("mixed").over(Window.partitionBy())  # one row a source
    return out.select("source", "target_share", (F.col("mixed") / F.nullif(total, F.lit(0))).alias("actual_share"), (F.col("mixed") / F.nullif(F.col("total"), F.lit(0))).alias("share_of_wanted_total"), F.col("mixed").alias("mixed_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats", "short")


def short_sources(documents: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 0, **how) -> DataFrame:
    """(source) of the targets whose drawn copies fall short of their share of as many tokens as all documents have: the mix takes all a source can give before it does."""
    counts = Scratch(documents.sparkSession, "mix-counts").keep(token_counts(documents, **how))
    plan = mix_plan(counts, targets)
    drawn = mixed_copies(counts, plan, shards, seed).groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("drawn"))
    return plan.join(drawn, "key", "left").where(F.coalesce("drawn", F.lit(0)) < F.col("target_share") * F.col("total")).select("source")
