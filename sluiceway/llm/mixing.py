"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Weights follow a temperature path from the sources' own
token shares to the wanted ones: w ~ share * (target / share) ** t, where the exponent t is 1 (the
targets themselves) if the repetition limits allow the budget, and else the largest that does,
found by bisection. A budget as large as the listed sources (``listed_tokens``) repeats the small ones
and thins the large; without a budget the largest one is taken for which t = 1 is allowed. The
plain form, w ~ share ** t bisected to a target entropy, is ``temperature_weights``.

Each source is then drawn as whole passes over its documents plus a part of one more: its documents
are permuted in blocks by a hash, blocks are taken until the budget is met, the last block is taken
in sub-blocks, and the last sub-block document by document. Prefix sums run over blocks, so no task
ever orders a whole source.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..session import cut
from .passes import map_batches

#: The tokenizer's file of byte-pair ranks, outside the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks of a source, and sub-blocks of a block.
BLOCKS = 1024
#: Sources that a mix may name.
MOST_SOURCES = 10_000
#: Characters from which on a text is counted in pieces, each up to the next word's end.
_PIECE = 100_000
_WORD_END = re.compile(r"\S(?=\s)")
#: Setting that names another file of byte-pair ranks; every worker must see it.
TOKENIZER_SETTING = "spark.sluiceway.tokenizer"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text. Long texts are counted piece by piece; pieces end where a word does, so that no token is cut."""
    enc = _encoder(path)
    n = at = 0
    while len(text) - at > _PIECE:
        end = _WORD_END.search(text, at + _PIECE)
        if end is None:
            break
        n += len(enc.encode_ordinary(text[at : end.end()]))
        at = end.end()
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of each distinct document; the source in lower case without blanks around it.

    Null or empty text has 0 tokens. Null ids are left out, null sources stay null.
    """
    tokenizer = tokenizer or docs.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER)
    rows = docs.select(F.col(id_col).cast("bigint"), F.nullif(F.lower(F.trim(F.col(source_col))), F.lit("")).alias("s"), text_col).filter(F.col(id_col).isNotNull())

    def make():
        return lambda ids, sources, texts: (ids, sources, [count_tokens(t, tokenizer) if t else 0 for t in texts])

    counted = map_batches(rows, make, "doc_id bigint, source string, n_tokens bigint", scan=True)
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(tokens: dict[str, float], target_entropy: float) -> dict[str, float]:
    """w ~ share ** t with t in [0, 1] bisected so that the weights' entropy meets ``target_entropy`` (or comes closest)."""
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n > 0} if total else {}

    def at(t: float) -> dict[str, float]:
        w = {s: p**t for s, p in shares.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    lo, hi = 0.0, 1.0  # entropy falls as t grows
    for _ in range(60):
        mid = (lo + hi) / 2
        if entropy(list(at(mid).values())) > target_entropy:
            lo = mid
        else:
            hi = mid
    return at((lo + hi) / 2) if shares else {}


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None) -> tuple[float, dict[str, float], float]:
    """(exponent, weight of each drawable source, budget in tokens).

    Drawable are the listed sources with tokens, a positive target and at least one use; the others'
    targets cannot be met, and the drawable keep their proportions. A budget beyond what even the
    sources' own shares allow is cut to what the limits allow in all.
    """
    able = {s: (t, m) for s, (t, m) in targets.items() if tokens.get(s, 0) > 0 and t and t > 0 and m and m > 0}
    if not able:
        return 1.0, {}, 0.0
    wanted = sum(t for t, _ in able.values())
    target = {s: t / wanted for s, (t, _) in able.items()}
    most = {s: tokens[s] * m for s, (_, m) in able.items()}
    if budget is None:
        return 1.0, target, min(most[s] / target[s] for s in able)
    total = sum(tokens[s] for s in able)
    share = {s: tokens[s] / total for s in able}

    def at(t: float) -> dict[str, float]:
        w = {s: share[s] * (target[s] / share[s]) ** t for s in able}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    fits = lambda t: all(budget * w <= most[s] * (1 + 1e-9) for s, w in at(t).items())
    if fits(1.0):
        return 1.0, target, budget
    if not fits(0.0):
        left = min(budget, sum(most.values()))
        quota = {s: 0.0 for s in able}
        open_ = dict(target)
        while left > 1e-6 and open_:  # what the capped sources leave goes to the others
            z = sum(open_.values())
            full = [s for s in open_ if quota[s] + left * open_[s] / z >= most[s]]
            if not full:
                for s in open_:
                    quota[s] += left * open_[s] / z
                break
            for s in full:
                left -= most[s] - quota[s]
                quota[s] = most[s]
                del open_[s]
        spent = sum(quota.values())
        return 0.0, {s: q / spent for s, q in quota.items()}, spent
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo, at(lo), budget


_PLAN = StructType([StructField("source", StringType()), StructField("whole", LongType()), StructField("rest", DoubleType())])


def listed_tokens(counts: DataFrame, targets: DataFrame) -> int:
    """Tokens of the documents of all listed sources: the budget of a mix as large as what it is drawn from."""
    listed = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    return counts.join(listed, "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0


def source_sizes(counts: DataFrame) -> dict[str, int]:
    """Tokens by source; more than ``MOST_SOURCES`` are refused."""
    rows = counts.filter("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r["source"]: r["n"] for r in rows}


def draw(counts: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 9) -> tuple[DataFrame, dict]:
    """Documents drawn for a mix: ``doc_id, source, n_tokens, repeats``; and the plan's numbers.

    ``targets``: ``source, target_share, max_repeats``, each source once (later rows of a repeated
    source are ignored). Tokens miss a source's quota by at most half its smallest fitting document. Documents of unlisted or null sources are not drawn; empty documents have nothing to draw.
    """
    spark = counts.sparkSession
    listed = targets.select(F.lower(F.trim("source")).alias("s"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted: dict[str, tuple[float, int]] = {}
    for s, t, m in sorted((r for r in listed if r[0]), key=lambda r: r[0]):
        wanted.setdefault(s, (t or 0.0, m or 0))
    sizes = counts.filter(F.col("source").isin(sorted(wanted)) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    tokens = {r["source"]: r["n"] for r in sizes}
    exponent, weights, spent = plan(tokens, wanted, budget)
    rows = []
    for s, w in weights.items():
        quota = min(spent * w, tokens[s] * wanted[s][1])
        whole = int(quota // tokens[s] + 1e-9)
        rows.append((s, whole, max(0.0, quota - whole * tokens[s])))
    plan_df = F.broadcast(spark.createDataFrame(rows, _PLAN))  # at most MOST_SOURCES rows
    h = F.xxhash64("doc_id", F.lit(seed))
    docs = counts.filter("n_tokens > 0").join(plan_df, "source").withColumns({"h": h, "block": F.pmod(h, F.lit(BLOCKS)), "sub": F.pmod(F.shiftright(h, 10), F.lit(BLOCKS))})

    def boundary(rows: DataFrame, by: str, before: str) -> DataFrame:
        """The block of each source in which its rest runs out, and the tokens before it."""
        per = rows.groupBy("source", by).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first(before).alias("b") if before else F.lit(0).cast("bigint").alias("b"))
        cum = F.sum("n").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) + F.col("b")
        per = per.withColumn("cum", cum).filter(F.col("cum") > F.col("rest"))  # BLOCKS rows a source
        return per.groupBy("source").agg(F.min(F.struct(by, (F.col("cum") - F.col("n")).alias("before"))).alias("m")).select("source", F.col(f"m.{by}").alias(f"last_{by}"), F.col("m.before").alias(f"before_{by}"))

    first = boundary(docs, "block", "")
    docs = docs.join(F.broadcast(first), "source", "left")
    inner = docs.filter(F.col("block") == F.col("last_block"))
    second = boundary(inner, "sub", "before_block")
    docs = docs.join(F.broadcast(second), "source", "left")
    edge = (F.col("block") == F.col("last_block")) & (F.col("sub") == F.col("last_sub"))
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before_sub")
    taken = docs.filter(edge).withColumn("extra", (run <= F.col("rest")).cast("int"))
    before = F.col("last_block").isNull() | (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("sub") < F.col("last_sub")))
    rest = docs.filter(~F.coalesce(edge, F.lit(False))).withColumn("extra", F.coalesce(before, F.lit(False)).cast("int"))
    cols = ["doc_id", "source", "n_tokens", "whole", "rest", "extra", "h"]
    both = cut(rest.select(*cols).unionByName(taken.select(*cols)))  # a few numbers a document, read three times below
    # what is still missing goes to the one document left whose size comes closest, if it comes closer than none
    short = both.groupBy("source").agg((F.first("rest") - F.sum(F.col("n_tokens") * F.col("extra"))).alias("gap"))
    open_ = both.filter("extra = 0").join(F.broadcast(short), "source")
    last = open_.groupBy("source").agg(F.min(F.struct(F.abs(F.col("n_tokens") - F.col("gap")).alias("off"), "h", "doc_id", "gap")).alias("m"))
    last = last.filter("m.off < m.gap").select("source", F.col("m.doc_id").alias("doc_id"), F.lit(1).alias("fill"))
    both = both.join(F.broadcast(last), ["source", "doc_id"], "left")
    repeats = (F.col("whole") + F.col("extra") + F.coalesce("fill", F.lit(0))).cast("bigint").alias("repeats")
    out = both.select("doc_id", "source", "n_tokens", repeats).filter("repeats > 0")
    return out, {"exponent": exponent, "weights": weights, "budget": spent, "tokens": tokens, "targets": wanted}


def report(drawn: DataFrame, counts: DataFrame, targets: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Per listed source: target and reached share of all drawn tokens, tokens there and drawn, repeats used and allowed, and the plan's exponent."""
    listed = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    there = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    all_drawn = got.agg(F.sum("drawn_tokens").alias("all_drawn"))
    met = listed.join(F.broadcast(there), "source", "left").join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(all_drawn))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    share = F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_drawn"), F.lit(0.0)), 6)
    return met.select("source", "target_share", share.alias("reached_share"), zero("tokens"), zero("drawn_tokens"), zero("most_repeats"), "max_repeats", F.lit(round(exponent, 6)).alias("exponent"))
