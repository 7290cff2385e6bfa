"""Search over an archive for a batch of queries: token overlap, vectors, ranking, caps; and near-duplicate scores."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.plans import match_weight
from . import ranking as R

#: Queries a block, blocks a pass over the texts, and bytes of query text a block: what is sent to every task at once.
BLOCK, PASS, BLOCK_BYTES = 2000, 16, 8 << 20
#: Rows of texts times queries that a task scores at once.
CELLS = 1 << 22
#: What lexical search looks at: one row a searchable piece.
PIECES = "video_id long, title string, place string, piece_idx long, text string, timestamp double, speaker string"


def pieces(recordings: DataFrame, segments: DataFrame, summaries: DataFrame, slides: DataFrame) -> DataFrame:
    """All that search may find in recordings, as rows of PIECES: segments, executive summaries, key points, topics, slides.

    recordings: video_id, title, filename; segments: video_id, seg_idx, start, text, speaker; summaries: video_id,
    executive_summary, key_points, topics (timestamp, topic, summary); slides: video_id, slide_idx, timestamp, title,
    content. A topic's and a slide's two texts are joined by a space. Blank texts go.
    """
    none = F.lit(None)

    def line(df, place, idx, text, at=none, speaker=none):
        return df.select("video_id", F.lit(place).alias("place"), idx.cast("long").alias("piece_idx"), T.stripped(text).alias("text"), at.cast("double").alias("timestamp"), speaker.cast("string").alias("speaker"))

    both = lambda a, b: F.concat_ws(" ", *[F.nullif(T.stripped(F.coalesce(c, F.lit(""))), F.lit("")) for c in (a, b)])
    points = summaries.select("video_id", F.posexplode("key_points").alias("i", "text"))
    topics = summaries.select("video_id", F.posexplode("topics").alias("i", "t"))
    rows = line(segments, "segment", F.col("seg_idx"), F.col("text"), F.col("start"), F.col("speaker"))
    for more in (
        line(summaries, "executive", F.lit(0), F.col("executive_summary")), line(points, "key_point", F.col("i"), F.col("text")),
        line(topics, "topic", F.col("i"), both(F.col("t.topic"), F.col("t.summary")), T.seconds_of(F.col("t.timestamp"))),
        line(slides, "slide", F.col("slide_idx"), both(F.col("title"), F.col("content")), F.col("timestamp")),
    ):
        rows = rows.unionByName(more)
    names = recordings.select("video_id", F.coalesce("title", "filename").alias("title"))
    return rows.where("text <> ''").join(names, "video_id", "left").select("video_id", "title", "place", "piece_idx", "text", "timestamp", "speaker")


class _Block:
    """Some queries as arrays: their tokens' postings, and what a text must have to hold a whole query."""

    def __init__(self, rows):
        self.ids = np.array([r.query_id for r in rows], np.int64)
        self.texts = [r.low for r in rows]
        self.size = np.array([len(r.tokens) for r in rows], np.float64)
        self.inner = np.array([len(r.inner) for r in rows], np.int64)
        words = sorted({t for r in rows for t in r.tokens})
        place = {w: k for k, w in enumerate(words)}
        own = sorted((place[t], q) for q, r in enumerate(rows) for t in r.tokens)
        self.words = pa.array(words, pa.string())
        self.owner = np.array([q for _, q in own], np.int64)
        self.cut = np.searchsorted(np.array([w for w, _ in own], np.int64), np.arange(len(words) + 1))
        #: queries that a text may hold without sharing a token with them
        self.alone = np.flatnonzero((self.inner == 0) & np.array([t != "" for t in self.texts], bool))

    def scores(self, low: pa.Array, tokens: pa.ListArray) -> np.ndarray:
        """Score of every text (rows) for every query (columns): shared tokens by both sizes, 2 for the whole query."""
        n, m = len(low), len(self.ids)
        sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
        found = pc.index_in(tokens.flatten(), self.words)
        row, known = np.repeat(np.arange(n), sizes), found.is_valid().to_numpy(zero_copy_only=False)
        word = found.fill_null(0).to_numpy(zero_copy_only=False)[known]
        count = self.cut[word + 1] - self.cut[word]
        base = np.repeat(self.cut[word] - (np.cumsum(count) - count), count)
        cells = np.repeat(row[known], count) * m + self.owner[base + np.arange(len(base))]
        common = np.bincount(cells, minlength=n * m).reshape(n, m)
        out = np.zeros((n, m))
        some = np.flatnonzero(self.inner)
        texts = low.to_pylist()
        for i, k in zip(*np.nonzero(common[:, some] >= self.inner[some])):
            if self.texts[some[k]] in texts[i]:
                out[i, some[k]] = 2.0
        for q in self.alone:
            out[pc.match_substring(low, self.texts[q]).to_numpy(zero_copy_only=False), q] = 2.0
        return out + common / np.maximum(self.size, 1) + common / np.maximum(sizes, 1)[:, None]


def _blocks(rows):
    """Lists of at most BLOCK rows and about BLOCK_BYTES of text."""
    held, size = [], 0
    for r in rows:
        if held and (len(held) == BLOCK or size > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r.low)
    if held:
        yield held


def _best(found: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The first `limit` rows of each query: greatest score, then earliest, then greatest title and text, then least ids."""
    at = found.assign(_t=found.timestamp.fillna(0.0))
    at = at.sort_values(["query_id", "score", "_t", "title", "text", "video_id", "place", "piece_idx"], ascending=[True, False, True, False, False, True, True, True], kind="stable")
    return at.groupby("query_id", sort=False).head(limit).drop(columns="_t")


def lexical(queries: DataFrame, pieces: DataFrame, limit: int = 24, speaker: str | None = None) -> DataFrame:
    """The best pieces of each query (query_id, text): rows of PIECES with score and rank.

    Every query meets every piece: shares of common tokens on both sides, 2 for the whole query inside the piece, and the
    bonus of its place where that is above 0. With speaker, only that speaker's segments and all other places. Queries go
    to the tasks in blocks of a bounded size, PASS blocks a pass; a task keeps its best `limit` rows a query, so only
    those are shuffled. A whole query in a text implies its inner tokens are there, so such pairs are looked up among
    those with common tokens, and only queries without an inner token are searched for in every text. Order: score,
    earlier, greater title, greater text; then the least ids. Null query texts find nothing; null titles count as empty.
    """
    spark = pieces.sparkSession
    low = F.lower(T.stripped(F.coalesce("text", F.lit(""))))
    asked = queries.select("query_id", low.alias("low"), T.search_tokens(low).alias("tokens"), F.array_distinct(T.inner_tokens(low)).alias("inner")).where("low <> ''")
    texts = pieces.where("text <> ''")
    texts = texts if speaker is None else texts.where((F.col("place") != "segment") | (F.col("speaker") == speaker))
    texts = texts.select("video_id", F.coalesce("title", F.lit("")).alias("title"), "place", "piece_idx", "text", "timestamp", "speaker", R.place_bonus(F.col("place")).alias("bonus"), F.lower("text").alias("low"), T.search_tokens("text").alias("tokens"))
    keep = ["video_id", "title", "place", "piece_idx", "text", "timestamp", "speaker"]

    def scan(blocks):
        shared = [spark.sparkContext.broadcast(_Block(b)) for b in blocks]

        def run(batches):
            held, least = None, [np.zeros(len(b.value.ids)) for b in shared]
            for batch in batches:
                for k, b in enumerate(x.value for x in shared):
                    step, some = max(1, CELLS // len(b.ids)), []
                    for i in range(0, batch.num_rows, step):
                        part = batch.slice(i, step)
                        score = b.scores(part["low"], part["tokens"])
                        score = np.where(score > 0, score + part["bonus"].to_numpy()[:, None], 0.0)
                        if len(score) > limit:
                            least[k] = np.maximum(least[k], np.partition(score, -limit, axis=0)[-limit])
                        row, q = np.nonzero((score > 0) & (score >= least[k]))
                        rows = part.select(keep).take(pa.array(row)).to_pandas()
                        some.append(rows.assign(query_id=b.ids[q], score=score[row, q]))
                    held = _best(pd.concat(([] if held is None else [held]) + some), limit)
            if held is not None and len(held):
                yield pa.RecordBatch.from_pandas(held, schema=_FOUND, preserve_index=False)

        return texts.mapInArrow(run, f"query_id long, {PIECES}, score double")

    blocks, found = list(_blocks(asked.toLocalIterator())), None
    for i in range(0, len(blocks), PASS):
        part = scan(blocks[i : i + PASS])
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id long, {PIECES}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.coalesce("timestamp", F.lit(0.0)), F.col("title").desc(), F.col("text").desc(), "video_id", "place", "piece_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("score", F.round("score", 6))


_FOUND = pa.schema([("query_id", pa.int64()), ("video_id", pa.int64()), ("title", pa.string()), ("place", pa.string()), ("piece_idx", pa.int64()), ("text", pa.string()), ("timestamp", pa.float64()), ("speaker", pa.string()), ("score", pa.float64())])
#: The result type of each place.
KIND = {"segment": "transcript", "executive": "summary", "key_point": "summary", "topic": "topic", "slide": "slide"}


def kind_of(place):
    out = F
    for k, v in KIND.items():
        out = out.when(place == k, v)
    return out


def cap_per_recording(ranked: DataFrame, n: int = 3, limit: int | None = None) -> DataFrame:
    """The first n rows of each recording and query, in rank order, and of those the first `limit` of each query."""
    w = Window.partitionBy("query_id", "video_id").orderBy("rank")
    rows = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    if limit is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= limit)
    return rows.drop("_r")


def ask_cap(recordings: int) -> int:
    """Rows a recording in an answer's context: 1 where several recordings are asked, else 5."""
    return 1 if recordings > 1 else 5


def pool(limit: int) -> int:
    """How many lexical rows a search of `limit` results looks at."""
    return max(6 * limit, 24)


def vector_pool(wanted: int) -> int:
    """How many chunks a search asks the vectors for, beside its pool: five times as many."""
    return max(5 * wanted, wanted)


def nearest_vectors(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, cosine): the exact k nearest chunks; ties to the least chunk_id.

    Queries go to the tasks in blocks of a bounded size, PASS blocks a pass; a task keeps its best k rows a query.
    """
    spark = chunks.sparkSession

    def part(blocks):
        shared = [spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), _unit(np.array([r.vector for r in rows], np.float64)))) for rows in blocks]

        def run(batches):
            held = [None] * len(shared)
            for pdf in batches:
                unit, chunk = _unit(np.stack(pdf.vector.to_numpy()).astype(np.float64)).T, pdf.chunk_id.to_numpy()
                for n, (ids, q) in enumerate(x.value for x in shared):
                    sims = np.round(q @ unit, 9)
                    top = [np.lexsort((chunk, -row))[:k] for row in sims]
                    rows = pd.DataFrame({"query_id": np.repeat(ids, [len(t) for t in top]), "chunk_id": np.concatenate([chunk[t] for t in top]), "cosine": np.concatenate([row[t] for row, t in zip(sims, top)])})
                    rows = rows if held[n] is None else pd.concat([held[n], rows])
                    held[n] = rows.sort_values(["query_id", "cosine", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            yield from (rows for rows in held if rows is not None)

        return chunks.where("vector is not null").select("chunk_id", "vector").mapInPandas(run, "query_id long, chunk_id long, cosine double")

    rows, blocks, found = queries.where("vector is not null").select("query_id", "vector").toLocalIterator(), [], None
    while block := list(itertools.islice(rows, BLOCK)):
        blocks.append(block)
        if len(blocks) == PASS:
            found, blocks = part(blocks) if found is None else found.unionByName(part(blocks)), []
    if blocks:
        found = part(blocks) if found is None else found.unionByName(part(blocks))
    if found is None:
        found = spark.createDataFrame([], "query_id long, chunk_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def similar_recordings(queries: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, video_id, score, rank): recordings like those of the queries (query_id, vector, own_id), by the chunks
    (chunk_id, vector, video_id, type, section, text) nearest to them: pool(n) a query, those with something to say."""
    near = nearest_vectors(queries, chunks, pool(n)).drop("rank")
    known = chunks.select("chunk_id", "video_id", "type", "section", F.coalesce("text", F.lit("")).alias("text"))
    hits = near.join(known, "chunk_id").where(T.meaningful("text", F.col("type")))
    hits = hits.withColumn("weighted", F.col("cosine") * match_weight(F.col("type"), F.col("section")))
    return recording_scores(hits.join(queries.select("query_id", "own_id"), "query_id"), n)


def recording_scores(hits: DataFrame, n: int = 5) -> DataFrame:
    """Recordings of each query by their two best weighted chunks: 0.7 best + 0.3 mean; hits: query_id, own_id, video_id, weighted."""
    other = hits.where("video_id <> own_id")
    top = other.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(F.col("weighted").desc()))).where("_r <= 2")
    score = top.groupBy("query_id", "video_id").agg(F.round(0.7 * F.max("weighted") + 0.3 * F.avg("weighted"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "video_id")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
