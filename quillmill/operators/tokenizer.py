"""Tokenizers over DataFrames: train, encode, decode, score, compare, choose."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from quillmill.functions import text as X
from quillmill.functions.bpe import SPECIAL_TOKENS, BpeModel
from quillmill.functions.shingles import steps

#: Bytes of distinct texts that the driver trainer may hold.
MOST_TRAINING_BYTES = 256 << 20
#: Token ids that one step of a pair count holds, and distinct pairs that a task adds up before it gives them.
STEP_IDS, MOST_PAIRS = 500_000, 1_000_000
Tokenizer = Callable[[Column], Column]
#: Reference tokenizers by name: a text column to its number of tokens. Callers may add their own.
TOKENIZERS: dict[str, Tokenizer] = {"byte": X.utf8_bytes, "char": X.characters, "whitespace": X.whitespace_tokens}


def model_from_table(merges: DataFrame) -> BpeModel:
    """The model of (merge_rank, left_id, right_id); a vocabulary is small by nature, and its size is checked."""
    n = merges.count()
    if n > 1 << 20:
        raise ValueError(f"{n} merges are too many for a tokenizer")
    return BpeModel([(r["left_id"], r["right_id"]) for r in merges.orderBy("merge_rank").collect()])


def encode(model: BpeModel) -> Tokenizer:
    """A column function: token ids of a text (null for null)."""

    def apply(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        ids = model.encode_batch(list(s[there]))
        out[there] = pd.Series([np.asarray(i, np.int32) for i in ids], index=s.index[there], dtype=object)
        return out

    return F.pandas_udf(apply, ArrayType(IntegerType()))


def token_count(model: BpeModel) -> Tokenizer:
    """A column function: number of tokens of a text (0 for null)."""

    def apply(s: pd.Series) -> pd.Series:
        return pd.Series(model.counts([t or "" for t in s]), index=s.index)

    return F.pandas_udf(apply, LongType())


def decode(model: BpeModel) -> Tokenizer:
    """A column function: text of token ids; an unknown id or bytes that aren't UTF-8 raise."""

    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda ids: None if ids is None else model.decode(ids))

    return F.pandas_udf(apply, StringType())


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.nonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _adjacent(found: Iterator[tuple[list, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Counts of the adjacent pairs in sequences of ids with weights, a step at a time; added up before they are given."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = lambda: pd.DataFrame({"left_id": (total[0] >> 32).astype(np.int32), "right_id": (total[0] & 0xFFFFFFFF).astype(np.int32), "n": total[1]})
    for seqs, weights in found:
        for lo, hi in steps(seqs, STEP_IDS):
            n = np.fromiter(map(len, seqs[lo:hi]), np.int64, hi - lo)
            ids = np.concatenate([np.asarray(s, np.int64) for s in seqs[lo:hi]])
            inside = np.ones(len(ids), bool)
            inside[(np.cumsum(n) - 1)[n > 0]] = False
            at = np.nonzero(inside)[0]
            more = _summed((ids[at] << 32) | ids[at + 1], np.repeat(weights[lo:hi], np.maximum(n - 1, 0)))
            total = _summed(np.concatenate([total[0], more[0]]), np.concatenate([total[1], more[1]]))
            if len(total[0]) > MOST_PAIRS:
                yield rows()
                total = total[0][:0], total[1][:0]
    yield rows()


PAIRS = "left_id int, right_id int, n long"


def pair_counts(tokens: DataFrame, ids: str = "ids", weight: str | None = None) -> DataFrame:
    """(left_id, right_id, n): adjacent pairs of token ids; overlapping occurrences all count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _adjacent((list(b["ids"]), b["w"].to_numpy(np.int64)) for b in batches)

    rows = tokens.where(F.col(ids).isNotNull()).select(F.col(ids).alias("ids"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return rows.mapInPandas(count, PAIRS).groupBy("left_id", "right_id").agg(F.sum("n").alias("n"))


def text_pair_counts(texts: DataFrame, model: BpeModel) -> DataFrame:
    """``pair_counts`` of the tokens of ``text``, which no table holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (list(b["text"]) for b in batches)
        yield from _adjacent((model.encode_batch(t[lo:hi]), np.ones(hi - lo, np.int64)) for t in held for lo, hi in steps(t))

    return texts.where(F.col("text").isNotNull()).select("text").mapInPandas(count, PAIRS).groupBy("left_id", "right_id").agg(F.sum("n").alias("n"))


def top_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair, ties to the smallest."""
    return pairs.orderBy(F.desc("n"), "left_id", "right_id").limit(1)


def train_bpe(texts: DataFrame, vocab_size: int, special_tokens: Sequence[str] = SPECIAL_TOKENS) -> BpeModel:
    """Byte-level BPE on the texts of ``texts``; equal texts are one sequence with a weight, which changes nothing.

    Greedy training is sequential by definition. Where the distinct texts fit the driver they are trained there with
    incremental counts; beyond that every merge is one distributed count and one distributed rewrite."""
    distinct = texts.where("text <> ''").groupBy("text").agg(F.count("*").alias("w"))
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= MOST_TRAINING_BYTES:
        return BpeModel.train(((r["text"].encode("utf-8"), r["w"]) for r in distinct.toLocalIterator()), vocab_size, special_tokens)
    return train_bpe_distributed(distinct, vocab_size, special_tokens)


def train_bpe_distributed(distinct: DataFrame, vocab_size: int, special_tokens: Sequence[str] = SPECIAL_TOKENS, every: int = 20) -> BpeModel:
    """The same training with counts and rewrites on the workers; lineage is cut ``every`` few merges."""
    from quillmill.plans.durable import cut

    first = 256 + len(special_tokens)
    if vocab_size < first:
        raise ValueError(f"vocab_size must be at least {first}")
    merges: list[tuple[int, int]] = []
    base = cut(distinct.select("text", "w"), "bpe")

    def tokens(found: list[tuple[int, int]]) -> DataFrame:
        return base.select(encode(BpeModel(found, special_tokens))(F.col("text")).alias("ids"), "w")

    held = cut(tokens([]), "bpe")
    while first + len(merges) < vocab_size:
        best = top_pair(pair_counts(held, "ids", "w")).first()
        if best is None:
            break
        merges.append((best["left_id"], best["right_id"]))
        new = first + len(merges) - 1
        held = held.select(_merge_pair(*merges[-1], new)(F.col("ids")).alias("ids"), "w")
        if len(merges) % every == 0:
            held = cut(held, "bpe")
    return BpeModel(merges, special_tokens)


def _merge_pair(a: int, b: int, new: int) -> Tokenizer:
    def apply(s: pd.Series) -> pd.Series:
        out = []
        for ids in s:
            ids = np.asarray(ids)
            hits = np.nonzero((ids[:-1] == a) & (ids[1:] == b))[0]
            if a == b and len(hits):
                run = np.concatenate([[0], np.cumsum(np.diff(hits) != 1)])
                start = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1])
                hits = hits[(np.arange(len(hits)) - start[run]) % 2 == 0]
            ids = ids.copy()
            ids[hits] = new
            out.append(np.delete(ids, hits + 1))
        return pd.Series(out, index=s.index, dtype=object)

    return F.pandas_udf(apply, ArrayType(IntegerType()))


def score(probes: DataFrame, tokenizers: dict[str, Tokenizer] | None = None) -> DataFrame:
    """(tokenizer, level, language, domain, id, tokens, chars, bytes): totals over all, by language, domain and probe.

    Ratios are taken from the whole numbers. Every tokenizer is a column of one scan."""
    named = tokenizers or TOKENIZERS
    t = F.col("text")
    counted = probes.select("id", "language", "domain", X.characters(t).alias("chars"), X.utf8_bytes(t).alias("bytes"), F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.coalesce(f(t), F.lit(0)).cast("long").alias("tokens")) for n, f in named.items()]).alias("_all"))
    each = counted.select("id", "language", "domain", "chars", "bytes", F.inline("_all"))
    sums = each.groupingSets([("tokenizer",), ("tokenizer", "language"), ("tokenizer", "domain"), ("tokenizer", "id")], "tokenizer", "language", "domain", "id").agg(
        F.grouping_id("tokenizer", "language", "domain", "id").alias("_g"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
    level = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "language").when(F.col("_g") == 5, "domain").otherwise("probe")
    return sums.select("tokenizer", level.alias("level"), "language", "domain", "id", "tokens", "chars", "bytes")


def candidates(model: BpeModel, vocab_sizes: Sequence[int]) -> list[dict]:
    """Candidates of several sizes from one training to the largest: smaller ones are prefixes of its merges.

    Sizes that end in the same merges are one candidate with all its requested sizes."""
    out: list[dict] = []
    for size in sorted(set(vocab_sizes)):
        merges = model.merges[: max(0, size - model.first)]
        if out and out[-1]["merges"] == len(merges):
            out[-1]["requested_vocab_sizes"].append(size)
            continue
        effective = model.first + len(merges)
        out.append({"name": f"bpe-{size}", "requested_vocab_sizes": [size], "merges": len(merges), "effective_vocab_size": effective, "collapsed": effective < size, "model": BpeModel(merges, model.special_tokens)})
    return out


def recommend(scores: DataFrame, meta: DataFrame, smoke: bool = False) -> DataFrame:
    """The BPE candidate with the fewest tokens per byte (to four places), ties to the smaller vocabulary.

    ``meta``: (name, kind, effective_vocab_size, ord). Nothing is recommended in a smoke run (train == eval)."""
    ratio = F.round(X.ratio(F.col("tokens"), F.col("bytes")), 4)
    ranked = scores.where("level = 'overall'").join(meta.where("kind = 'bpe'"), F.col("tokenizer") == F.col("name")).select("name", ratio.alias("tokens_per_byte"), "effective_vocab_size", "ord")
    return ranked.where(F.lit(not smoke)).orderBy("tokens_per_byte", "effective_vocab_size", "ord").limit(1).drop("ord")


def smoke_evidence(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """(candidate, id, tokens): what the tightest BPE candidate makes of each probe."""
    best = recommend(scores, meta).select(F.col("name").alias("tokenizer"))
    return scores.where("level = 'probe'").join(F.broadcast(best), "tokenizer").select(F.col("tokenizer").alias("candidate"), "id", "tokens")


def embedding_cost(vocab_size: Column, d_model: int) -> Column:
    """Parameters of the embedding matrix."""
    return vocab_size.cast("long") * F.lit(d_model)


def gate(scores: DataFrame, language: str = "ja") -> DataFrame:
    """(tokenizer, byte_ja, candidate_ja, beats_byte_baseline, improvement_pct) on one language's tokens per character."""
    per = scores.where((F.col("level") == "language") & (F.col("language") == language)).select("tokenizer", F.round(X.ratio(F.col("tokens"), F.col("chars")), 4).alias("candidate_ja"))
    base = per.where("tokenizer = 'byte'").select(F.col("candidate_ja").alias("byte_ja"))
    gain = F.when(F.col("byte_ja") > 0, F.round((1 - F.col("candidate_ja") / F.col("byte_ja")) * 100, 1))
    return per.where(~F.col("tokenizer").isin(*TOKENIZERS)).crossJoin(F.broadcast(base)).select("tokenizer", "byte_ja", "candidate_ja", (F.col("candidate_ja") < F.col("byte_ja")).alias("beats_byte_baseline"), gain.alias("improvement_pct"))


def with_gains(table: DataFrame) -> DataFrame:
    """Eligible candidates in order of vocabulary with ``gain``, the relative cut over the size before.

    ``table``: (name, effective_vocab_size, collapsed, candidate_ja, beats_byte_baseline)."""
    order = Window.orderBy("effective_vocab_size", "name")
    before = F.lag("candidate_ja").over(order)
    gain = F.when(before.isNull(), F.lit(None).cast("double")).when(before == 0, F.lit(0.0)).otherwise((before - F.col("candidate_ja")) / before)
    return table.where(~F.col("collapsed") & F.col("beats_byte_baseline")).withColumns({"place": F.row_number().over(order), "gain": gain})


def choose_vocab(table: DataFrame, knee: float = 0.10) -> DataFrame:
    """(name, cost_knee_reached): the size before the first gain under ``knee``, else the one with the fewest tokens.

    Empty where no candidate is eligible."""
    ranked = with_gains(table)
    first = ranked.where(F.col("gain") < knee).agg(F.min("place").alias("knee"))
    joined = ranked.crossJoin(F.broadcast(first))
    at_knee = joined.where(F.col("knee").isNotNull() & (F.col("place") == F.greatest(F.lit(1), F.col("knee") - 1))).select("name", F.lit(True).alias("cost_knee_reached"))
    least = joined.where("knee is null").orderBy("candidate_ja", "effective_vocab_size").limit(1).select("name", F.lit(False).alias("cost_knee_reached"))
    return at_knee.unionByName(least)


# The roles of a chat and their markers.
ROLES = {"system": "<system>", "user": "<user>", "assistant": "<assistant>"}


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, text) of (conv_id, turn, role, content): one marked-up text per conversation, turns in order.

    A role without a marker raises; a conversation is as long as its own turns, so its group is bounded."""
    marker = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role"))
    known = F.coalesce(marker, F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("null")))).cast("string"))
    piece = F.concat(known, F.coalesce("content", F.lit("")), F.lit("<eos>"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("turns"))
    return turns.select("conv_id", F.concat(F.lit("<bos>"), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("text"))


def encode_chat(messages: DataFrame, model: BpeModel) -> DataFrame:
    """(conv_id, ids): the marked-up text as ordinary text; markers become the tokens of their letters."""
    return format_chat(messages).select("conv_id", encode(model)(F.col("text")).alias("ids"))
