"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens and neighbouring pairs): one of labelled good texts, one of the
whole raw corpus. A text's log weight is the log ratio of its probabilities under the two, the sum over its n-grams of
log target / raw, plus LASTING for each, the log ratio of the odds that a text of either model goes on (so a text is not
rejected for its length, as labelled texts are). Texts are then drawn without replacement with probabilities that follow
their weights, by Gumbel top-k: log weight / TEMPERATURE plus Gumbel noise that is a function of the id, the k greatest
kept. k is a parameter; by default it is the number of texts that are at least as likely under the target model as under
the raw one. Long texts have weights far from 1, so that noise decides among short and undecided ones.

Tokens are runs of ASCII punctuation or of anything else but white space. The raw counts cover every text; the target
model is fitted on at most LABELLED labelled rows (those of least id hash), a bound that also bounds what is broadcast:
two arrays of BUCKETS numbers and the labelled ids. Counts are added up in tasks and merged in groups, never by text.

Edge cases: null or empty texts have no n-grams, weight 0, and are not kept; without labelled rows every text with a
token is kept; ids labelled twice count as good only if every label says so; null ids take part, rows that repeat an id
share its noise, those that repeat its text too are judged alike, kept or not; other equal scores go to the smaller id; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import texts
from tessella.llm.ranks import ranked

BUCKETS, LABELLED, SEED = 1 << 17, 20_000, 11
LASTING, TEMPERATURE = 0.06, 1.0
#: Counts by which the target model leans on the raw one.
SHRINK = 32.0
#: Groups in which tasks' counts are merged before they reach the driver.
GROUPS = 16


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every token (a run of ASCII punctuation, or of other characters but white space); texts' offsets."""
    kind = np.full(256, 2, np.uint8)
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    hashes, starts_all = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    for start, end, _, _ in texts.word_bounds(raw, offsets):
        piece = raw[start:end]
        k = np.concatenate([[0], kind[piece], [0]])
        change = (k[1:] != k[:-1]) | edges[start : end + 1]
        at, to = np.flatnonzero(change & (k[1:] != 0)), np.flatnonzero(change & (k[:-1] != 0))
        hashes.append(texts.span_hashes(piece, at, to))
        starts_all.append(at + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets)


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every text's tokens and pairs, and each text's offset into them."""
    h, at = token_hashes(raw, offsets)
    pair = texts.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    last = np.zeros(len(h), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True  # a text's last token starts no pair
    grams = np.stack([h, np.concatenate([pair, np.zeros(1, np.uint64)])[: len(h)]], axis=1).ravel()
    real = np.stack([np.ones(len(h), bool), ~last], axis=1).ravel()
    place = np.concatenate([[0], np.cumsum(real)])[2 * at]
    return (grams[real] % np.uint64(buckets)).astype(np.int64), place


def labelled_ids(labels: DataFrame, most: int = LABELLED) -> np.ndarray:
    """Ids labelled good and not toxic, at most so many, by least hash."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 AND t = 0")
    rows = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.sort(np.array([r["doc_id"] for r in rows], np.int64))


def log_ratios(docs: DataFrame, good: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability of each bucket; zeros without labelled texts.

    The raw model has add-one smoothing. The target model is the raw one times (count + SHRINK) / (expected + SHRINK),
    scaled to sum to 1: where few target n-grams are expected, it leans on the raw model.

    docs: (id long, text string).
    """
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches):
        raw_n, good_n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in texts.sub_batches(batches):
            grams, at = ngram_buckets(*texts.text_bytes(b.column(1)), buckets)
            raw_n += np.bincount(grams, minlength=buckets)
            ids = b.column(0).fill_null(-1).to_numpy()
            hit = np.repeat(np.isin(ids, shared.value) & b.column(0).is_valid().to_numpy(zero_copy_only=False), np.diff(at))
            good_n += np.bincount(grams[hit], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([raw_n.tobytes()], pa.binary()), pa.array([good_n.tobytes()], pa.binary())], ["raw", "good"])

    def add(batches):
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            for i in range(2):
                for x in b.column(i).to_pylist():
                    sums[i] += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()) for s in sums], ["raw", "good"])

    schema = "raw binary, good binary"
    parts = docs.mapInArrow(texts.trimmed(count), schema).repartition(GROUPS).mapInArrow(add, schema).collect()  # GROUPS rows
    raw_n, good_n = (sum((np.frombuffer(p[c], np.int64) for p in parts), np.zeros(buckets, np.int64)) for c in ("raw", "good"))
    if not good_n.any():
        return np.zeros(buckets)
    raw_p = (raw_n + 1) / (raw_n.sum() + buckets)
    ratio = (good_n + SHRINK) / (good_n.sum() * raw_p + SHRINK)
    return np.log(ratio / (raw_p * ratio).sum())


def _scores(b: pa.RecordBatch, ratios: np.ndarray, temperature: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams, log weight and score (with the Gumbel noise of the id) of a batch's (id, text) rows."""
    grams, at = ngram_buckets(*texts.text_bytes(b.column(1)), len(ratios))
    n = np.diff(at)
    weight = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        weight[full] = np.add.reduceat(ratios[grams], at[full]) + LASTING * n[full]
    ids = b.column(0).fill_null(-1).to_numpy().astype(np.int64)
    u = (texts.mix(ids.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64)
    return n, weight, weight / temperature - np.log(-np.log((u + 0.5) / (1 << 53)))


def weighted(docs: DataFrame, ratios: np.ndarray, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(id, n_grams, log_weight, score) of every text of docs (id long, text string)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches):
        for b in texts.sub_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _scores(b, shared.value, temperature, seed))], ["id", "n_grams", "log_weight", "score"])

    return docs.mapInArrow(texts.trimmed(weigh), "id long, n_grams long, log_weight double, score double")


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, id_col: str, text_col: str):
    """The ranked scores of every text, with ``kept``, and (score, id) of the last kept one, the log ratios."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ratios = log_ratios(plain, labelled_ids(labels))
    scored = weighted(plain, ratios).withColumn("_less", F.when(F.col("n_grams") > 0, -F.col("score")).otherwise(F.lit(float("inf"))))
    placed, _ = ranked(scored, ["_less", "id"], "rank")
    if k is None:
        k = placed.agg(F.count_if((F.col("n_grams") > 0) & (F.col("log_weight") >= 0))).first()[0]
    last = placed.filter((F.col("rank") < k) & (F.col("n_grams") > 0)).agg(F.max(F.struct("rank", "score", "id"))).first()[0]
    if last is None:
        return placed.withColumn("kept", F.lit(False)), None, ratios
    score, at = last["score"], last["id"]
    before = F.col("id").isNull() if at is None else F.col("id").isNull() | (F.col("id") <= at)  # nulls sort first
    kept = (F.col("n_grams") > 0) & ((F.col("score") > score) | (F.col("score") == score) & before)
    return placed.withColumn("kept", kept), (score, at), ratios


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams, log_weight, score, rank and kept of every row; the k greatest scores of texts with tokens are kept, and
    rows that repeat the id and the score of the last of them."""
    placed, _, _ = _drawn(docs, labels, k, id_col, text_col)
    return placed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "score", "rank", "kept")


def drawn(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``resample`` keeps, all columns. Texts are not shuffled: the k-th score is the line."""
    _, last, ratios = _drawn(docs, labels, k, id_col, text_col)
    if last is None:
        return docs.limit(0)
    score, at = last
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    i, j = docs.columns.index(id_col), docs.columns.index(text_col)

    def keep(batches):
        for b in texts.sub_batches(batches, text_col):
            ids = b.column(i).cast(pa.int64())
            n, _, got = _scores(pa.RecordBatch.from_arrays([ids, b.column(j)], ["id", "text"]), shared.value, TEMPERATURE, SEED)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            before = null if at is None else null | (ids.fill_null(0).to_numpy() <= at)
            yield b.filter(pa.array((n > 0) & ((got > score) | (got == score) & before)))

    return docs.mapInArrow(texts.trimmed(keep), docs.schema)


def op5_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents with their weight, their place in the draw and whether they are kept."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
