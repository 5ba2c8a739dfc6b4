"""Full-text search over postings: weighted fields, AND and OR matches, two rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.vectors import one_block
from quillstone.functions.text import tokens

#: Weights of titles (A), headings (B) and contents (C), as usual defaults of weighted text search.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
#: Queries that are sent to the tasks at once.
BLOCK_QUERIES = 1000
#: Most rows of (query, term) that are broadcast; beyond it they are joined by shuffles.
BROADCAST_TERMS = 100_000


def postings(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``id, term, weight, position``: one row for each token; ``fields`` maps columns to weight letters.

    Positions run on from one field to the next, in the order of ``fields``.
    """
    def field(column: str, weight: str) -> Column:
        return F.transform(F.coalesce(tokens(F.col(column)), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    every = [field(c, w) for c, w in fields.items()]
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*every)).alias("position", "t")).select("id", "t.term", "t.weight", "position")


def term_frequencies(posted: DataFrame) -> DataFrame:
    """``id, term, tf_a, tf_b, tf_c``: occurrences of each term by weight: the form in which an index is kept."""
    return posted.groupBy("id", "term").agg(*(F.count_if(F.col("weight") == w).alias(f"tf_{w.lower()}") for w in WEIGHTS))


def refreshed(index: DataFrame, changed: DataFrame, posted: DataFrame) -> DataFrame:
    """``index`` after some documents changed: ``changed(id)`` names them, ``posted`` are their new postings (none if deleted)."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").unionByName(term_frequencies(posted))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id, term, terms``: the distinct tokens of each query and their number; a query without tokens has no row."""
    listed = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("t"))
    return listed.select("query_id", F.explode("t").alias("term"), F.size("t").alias("terms"))


def search(df: DataFrame, id_col: str, fields: dict[str, str], terms: DataFrame, mode: str, k: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, id, matched, score, rank``: the ``k`` best matches, all (``and``) or any (``or``) of a query's terms.

    The score is the weighted number of occurrences, dampened by 1 + ln. All tokens of a document lie in one row, so a task
    scores its documents against a block of queries and keeps ``k`` for each query: common terms never make a pair of query
    and document leave its task, and one small shuffle joins the tasks' best. Queries go out in blocks of bounded size, of which
    only one is held and broadcast at a time. Ties
    go to the smaller id; documents without a match, null ids and queries without terms have no rows.
    """
    ids = [F.col(id_col).cast("long").alias("id")]
    listed = df.select(*ids, *(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"f{i}") for i, c in enumerate(fields))).where("id IS NOT NULL")
    weights = [WEIGHTS[w] for w in fields.values()]
    kind = terms.schema["query_id"].dataType.simpleString()
    count = terms.select("query_id").distinct().count()
    parts = []
    for b in range(max(1, -(-count // block))):
        own = terms if count <= block else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-count // block))) == b)
        asked = own.select("query_id", "term", "terms").toArrow()
        query = pc.dictionary_encode(asked["query_id"]).combine_chunks()
        vocabulary = pc.unique(asked["term"])
        at = pc.index_in(asked["term"], vocabulary).to_numpy()
        has = np.zeros((len(query.dictionary), len(vocabulary)), np.float32)
        has[query.indices.to_numpy(), at] = 1
        sent = df.sparkSession.sparkContext.broadcast((query.dictionary, vocabulary, has))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, vocabulary, has = sent.value
            need = has.sum(1)
            for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                n, size = len(ids), len(vocabulary)
                gain, there = np.zeros((n, size)), np.zeros((n, size), bool)
                for i, w in enumerate(weights):
                    field = batch.column(f"f{i}")
                    row = np.repeat(np.arange(n), field.value_lengths().to_numpy())
                    term = pc.index_in(field.flatten(), vocabulary).fill_null(-1).to_numpy()
                    seen = np.bincount((row * size + term)[term >= 0], minlength=n * size).reshape(n, size)
                    gain += w * np.where(seen > 0, 1 + np.log(np.maximum(seen, 1)), 0)
                    there |= seen > 0
                score, matched = np.round(gain @ has.T.astype(float), 6), there.astype(np.float32) @ has.T
                good = (matched == need) if mode == "and" else matched > 0
                order = np.argsort(ids, kind="stable")
                ranked = np.where(good, -score, np.inf)[order]
                top = np.argsort(ranked, axis=0, kind="stable")[:k].T
                keep = np.isfinite(np.take_along_axis(ranked.T, top, 1))
                q = np.repeat(np.arange(len(names)), keep.sum(1))
                d = order[top[keep]]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids[d]), pa.array(matched[d, q].astype(np.int64)), pa.array(score[d, q])],
                                                 ["query_id", "id", "matched", "score"])

        found = listed.mapInArrow(best, f"query_id {kind}, id long, matched long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        parts.append(one_block(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), sent, -(-count // block)))
    return reduce(DataFrame.unionByName, parts)


def cover_density(posted: DataFrame, terms: DataFrame, k: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, id, covers, score, rank``: ``cover_search`` over postings, whose rows are first gathered by document."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    asked = terms.select("term").distinct()
    here = posted.where("id IS NOT NULL").join(F.broadcast(asked) if few else asked, "term", "left_semi")
    gathered = here.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "term"))).alias("t"))
    return _covers(gathered.select("id", F.col("t.term").alias("term"), F.col("t.position").alias("position")), terms, k, block)


def cover_search(df: DataFrame, id_col: str, fields: dict[str, str], terms: DataFrame, k: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, id, covers, score, rank``: the ``k`` best matches of each query by how close together its terms stand.

    A document must hold all terms of a query; only where no document does, any term is a match. A cover is a shortest stretch
    of positions that satisfies the query: one with every term, or where any term will do, one occurrence. It adds (number of
    terms) / (1 + its length beyond the number of terms), so an occurrence alone adds 1. Fields don't weigh differently.

    Positions run on from one field to the next, in the order of ``fields``. As in ``search`` a task scores its documents
    against a block of queries and keeps ``k`` for each query. Ties go to the smaller id.
    """
    every = F.concat(*(F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in fields))
    return _covers(df.select(F.col(id_col).alias("id"), every.alias("term")).where("id IS NOT NULL"), terms, k, block)


def _covers(docs: DataFrame, terms: DataFrame, k: int, block: int) -> DataFrame:
    """``cover_search`` over ``docs(id, term, position)``: arrays in order; without ``position`` it is the place in the array."""
    kinds = f"query_id {terms.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}"
    count = terms.select("query_id").distinct().count()
    parts = []
    for b in range(max(1, -(-count // block))):
        own = terms if count <= block else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-count // block))) == b)
        asked = own.select("query_id", "term").toArrow()
        query = pc.dictionary_encode(asked["query_id"]).combine_chunks()
        vocabulary = pc.unique(asked["term"])
        has = np.zeros((len(query.dictionary), len(vocabulary)), np.float32)
        has[query.indices.to_numpy(), pc.index_in(asked["term"], vocabulary).to_numpy()] = 1
        sent = docs.sparkSession.sparkContext.broadcast((query.dictionary, vocabulary, has))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, vocabulary, has = sent.value
            need, size = has.sum(1), len(vocabulary)
            for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
                batch = batch.take(pc.sort_indices(batch.column("id")))
                n, listed = batch.num_rows, batch.column("term")
                lengths = listed.value_lengths().to_numpy()
                row = np.repeat(np.arange(n), lengths)
                if "position" in batch.schema.names:
                    at = batch.column("position").flatten().to_numpy()
                else:
                    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                term = pc.index_in(listed.flatten(), vocabulary).fill_null(-1).to_numpy()
                row, at, term = row[term >= 0], at[term >= 0], term[term >= 0]
                seen = np.bincount(row * size + term, minlength=n * size).reshape(n, size)
                single = np.rint(seen.astype(np.float32) @ has.T).astype(np.int64)
                full = (seen > 0).astype(np.float32) @ has.T == need
                covers, score = np.zeros(full.shape, np.int64), np.zeros(full.shape)
                span = int(at.max(initial=0)) + 1
                first = np.searchsorted(row, np.arange(n + 1))
                for q in np.flatnonzero(full.any(0)):
                    held = np.flatnonzero(full[:, q])
                    many = first[held + 1] - first[held]
                    i = np.repeat(first[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    i = i[has[q, term[i]] > 0]
                    # places grow from document to document, so that a last place in an earlier one lies before this one's first
                    place, own = row[i] * span + at[i], term[i]
                    start = place
                    for t in np.flatnonzero(has[q]):
                        start = np.minimum(start, np.maximum.accumulate(np.where(own == t, place, -1)))
                    # of the stretches with one start only the first (shortest) is a cover
                    cover = (start >= row[i] * span) & np.concatenate(([True], start[1:] != start[:-1]))
                    d, gain = row[i][cover], need[q] / (1.0 + place[cover] - start[cover] + 1 - need[q])
                    covers[:, q], score[:, q] = np.bincount(d, minlength=n), np.round(np.bincount(d, gain, n), 6)
                for every, c, s in ((True, covers, score), (False, single, single.astype(float))):
                    ranked = np.where(c > 0, -s, np.inf)
                    top = np.argsort(ranked, axis=0, kind="stable")[:k].T
                    keep = np.isfinite(np.take_along_axis(ranked.T, top, 1))
                    q, d = np.repeat(np.arange(len(names)), keep.sum(1)), top[keep]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column("id").take(pa.array(d)), pa.array(np.full(len(d), every)),
                                                      pa.array(c[d, q]), pa.array(s[d, q])], ["query_id", "id", "every", "covers", "score"])

        parts.append(docs.mapInArrow(best, f"{kinds}, every boolean, covers long, score double"))
    w = Window.partitionBy("query_id")
    found = reduce(DataFrame.unionByName, parts).withColumn("_e", F.max("every").over(w)).where("every = _e").drop("every", "_e")
    return found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
