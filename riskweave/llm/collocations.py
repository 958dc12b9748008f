"""Phrase collocations from a weighted de Bruijn graph of three-word edges, per language.

* *Edges*: every three consecutive words of a piece are one edge, from the node of its first two words to the node of its last two.
  Tasks count the edges of a chunk of text before they are shuffled, one row a node with the edges that leave it, so a
  passage in a third of all documents costs a row a node and chunk.
* *Node flow*: a phrase of two words occurs as often as edges leave its node, plus as often as it ends a
  piece; a word as often as nodes begin with it, plus as often as it ends a piece. Chunks add these up from their edges and piece
  ends; the rows are exchanged once, by node, and the one exchange serves both the flows and the counts of heavy nodes' edges.
* *Unary paths*: among edges of at least ``MIN_COUNT``, a node with one edge in and one out is unary. ``JOIN_ROUNDS``
  rounds join a path that ends at a unary node to the one that starts there (nodes are paired by a coin of their hash, so
  paths grow without conflict); what a longer path leaves unjoined stays as several rows, which changes no count. A path carries its words, edge counts
  and node flows, so counts of all its phrases are read off the row; only its last node's flow is looked up.
* *Score*: with a phrase's count a and the counts l and r of the two parts of a cut, floor(10^6 a^2 / (l r)) in decimals of
  38 digits, exact while a < 10^13. Phrases inside a longer candidate that holds half their occurrences are dropped.

Defined results: null text is empty, a null lang is ``und`` (and one with such rows); words have no upper or lower bound on length; repeated
rows count each time; phrases of equal score and count are ordered by UTF-8 bytes; an empty table gives an empty result; extra columns
are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import text as T
from riskweave.session import reliable_checkpoint

MIN_COUNT = 10
TOP = 2000
JOIN_ROUNDS = 2
SALTS = 64
_CHUNK = 6 << 20
_PART_WORDS = 1 << 20
_BREAK = T.byte_class(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = T.byte_class(lambda b: not _BREAK[b] and b not in (0x20, 0x09))


# ---------------------------------------------------------------- edges
def _words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, piece number of each) of one chunk of lower-cased texts."""
    starts, ends, bounds = T.word_spans(data, offs, _WORD)
    kept = data[_WORD[data]]
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(kept.tobytes()))
    new = np.zeros(len(starts), bool)
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True                # first words of texts
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    new[1:] |= breaks[1:] != breaks[:-1]
    return words, np.cumsum(new)


def _edges(batches):
    """Each chunk's nodes: (lang, "w1 w2", flow, nexts), and its words: (lang, "w", flow, null).

    nexts holds a node's edges, null if it has none: next words, each with a count if that is not 1, between tabs.
    """
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        for lang, name in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(0).take(pa.array(np.flatnonzero(of_row == lang)))
            for _, _, data, offs in T.chunks(texts, _CHUNK):
                words, piece = _words(T.LOWER[data], offs)
                if len(words):
                    coded = words.dictionary_encode()
                    yield from _chunk(name, coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece)


def _chunk(lang: str, vocabulary: pa.Array, code: np.ndarray, piece: np.ndarray):
    for a in range(0, len(code), _PART_WORDS):     # a text longer than a chunk: nodes that start in a part, seen with two words more
        used, c = np.unique(code[a:a + _PART_WORDS + 2], return_inverse=True)
        p, words, size = piece[a:a + _PART_WORDS + 2], vocabulary.take(pa.array(used)), len(used)
        here = min(_PART_WORDS, len(code) - a)
        follows = np.zeros(here, bool)
        follows[:len(p) - 1] = (p[1:] == p[:-1])[:here]
        at = np.flatnonzero(follows)
        third = np.zeros(len(at), bool)
        inside = at + 2 < len(p)
        third[inside] = p[at[inside] + 2] == p[at[inside]]
        node = c[at] * size + c[at + 1]
        # three codes of a part fit 63 bits: it has at most 2^20 + 2 words
        edges, n = np.unique(node[third] * size + c[at[third] + 2], return_counts=True)
        ends, n_end = np.unique(node[~third], return_counts=True)
        nodes = np.union1d(edges // size, ends)
        of_edge = np.searchsorted(nodes, edges // size)
        flow = np.bincount(of_edge, n, len(nodes)) + np.bincount(np.searchsorted(nodes, ends), n_end, len(nodes))
        word_flow = np.bincount(nodes // size, flow, size) + np.bincount(c[:here][~follows], minlength=size)
        heads = pc.binary_join_element_wise(words.take(pa.array(nodes // size)), words.take(pa.array(nodes % size)), _text(" "))
        nexts = words.take(pa.array(edges % size))
        nexts = pc.if_else(pa.array(n == 1), nexts, pc.binary_join_element_wise(nexts, _numbers(n), _text(" ")))
        with_edges = np.unique(of_edge)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(np.searchsorted(of_edge, with_edges), len(edges))), nexts)
        place = np.full(len(nodes), -1)
        place[with_edges] = np.arange(len(with_edges))
        joined = pc.binary_join(lists, _text("\t")).take(pa.array(place, mask=place < 0))
        seen = np.flatnonzero(word_flow)
        yield _rows(lang, heads, flow, joined)
        yield _rows(lang, words.take(pa.array(seen)), word_flow[seen], pa.nulls(len(seen), pa.string()))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _numbers(n: np.ndarray) -> pa.Array:
    return pa.array(n.astype(np.int64)).cast(pa.large_string())


def _rows(lang: str, head: pa.Array, flow: np.ndarray, nexts: pa.Array) -> pa.RecordBatch:
    langs = pa.array([lang]).take(pa.array(np.zeros(len(head), np.int64)))
    return pa.RecordBatch.from_arrays([langs, head.cast(pa.string()), pa.array(flow.astype(np.int64)), nexts.cast(pa.string())],
                                      ["lang", "head", "flow", "nexts"])


# ---------------------------------------------------------------- graph
def graph(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, words, edges): (lang, node, flow) of two-word phrases and (lang, node, next, n) of edges of at least min_count,
    (lang, word, flow) of all words."""
    posted = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")) \
        .mapInArrow(_edges, "lang string, head string, flow long, nexts string")
    is_node = F.col("head").contains(" ")
    # an edge is no heavier than its node, so edges of light nodes are never taken apart; one exchange serves flows and edges
    total = F.sum("flow").over(Window.partitionBy("lang", "head"))
    kept = posted.withColumn("total", total).where(~is_node | (F.col("total") >= min_count))
    entry, first = F.col("col"), F.col("pos") == 0
    counted = kept.select("lang", "head", F.posexplode(F.split(F.concat_ws("\t", F.col("flow").cast("string"), "nexts"), "\t"))).select(
        "lang", "head", F.when(~first, F.substring_index(entry, " ", 1)).alias("next"),
        F.when(first, entry).when(entry.contains(" "), F.substring_index(entry, " ", -1)).otherwise(F.lit("1")).cast("long").alias("n"))
    table = reliable_checkpoint(counted.groupBy("lang", "head", "next").agg(F.sum("n").alias("n"))
                                .where(F.col("next").isNull() | (F.col("n") >= min_count)))
    nodes = table.where(is_node & F.col("next").isNull()).select("lang", F.col("head").alias("node"), F.col("n").alias("flow"))
    words = table.where(~is_node).select("lang", F.col("head").alias("word"), F.col("n").alias("flow"))
    return nodes, words, table.where("next is not null").select("lang", F.col("head").alias("node"), "next", "n")


def _second(column: str):
    return F.substring_index(column, " ", -1)


def paths(nodes: DataFrame, edges: DataFrame, rounds: int = JOIN_ROUNDS) -> DataFrame:
    """(lang, start, end, words, counts, flows): unary paths of heavy edges, each edge in exactly one.

    words has two more entries than counts, the edges' counts; flows holds the flow of each edge's first node.
    """
    end = F.concat_ws(" ", _second("node"), F.col("next"))
    rows = edges.join(nodes.withColumnRenamed("flow", "node_flow"), ["lang", "node"]).withColumn("end", end)
    outs = edges.groupBy("lang", "node").agg(F.count("*").alias("outs")).where("outs = 1")
    into = edges.groupBy("lang", end.alias("node")).agg(F.count("*").alias("ins")).where("ins = 1")
    # the nodes at which paths may be joined: one heavy edge in, one out
    unary = reliable_checkpoint(outs.join(into, ["lang", "node"]).select("lang", "node"))
    at = reliable_checkpoint(rows.select("lang", F.col("node").alias("start"), "end", F.array_append(F.split("node", " "), F.col("next")).alias("words"),
                                         F.array("n").alias("counts"), F.array("node_flow").alias("flows")))
    for i in range(rounds):
        coin = lambda c, i=i: F.pmod(F.xxhash64(F.lit(i), "lang", c), F.lit(2))
        # the coin of a path's start says whether it takes (0) or is taken (1) in this round
        joints = unary.select("lang", F.col("node").alias("joint"))
        taken = at.where(coin("start") == 1).join(joints.withColumnRenamed("joint", "start"), ["lang", "start"])
        ahead = taken.select("lang", F.col("start").alias("end"), F.lit(True).alias("more"), F.col("end").alias("end2"),
                             F.col("words").alias("words2"), F.col("counts").alias("counts2"), F.col("flows").alias("flows2"))
        takers = at.where(coin("start") == 0).join(ahead, ["lang", "end"], "left")
        grown = takers.select("lang", "start", F.coalesce("end2", "end").alias("end"),
                              F.when(F.col("more"), F.concat("words", F.slice("words2", F.lit(3), F.size("words2")))).otherwise(F.col("words")).alias("words"),
                              F.when(F.col("more"), F.concat("counts", "counts2")).otherwise(F.col("counts")).alias("counts"),
                              F.when(F.col("more"), F.concat("flows", "flows2")).otherwise(F.col("flows")).alias("flows"))
        # a taken path is left out where some taker ends at its start
        gone = at.where(coin("start") == 0).select("lang", F.col("end").alias("start")).join(joints.withColumnRenamed("joint", "start"), ["lang", "start"])
        left = at.where(coin("start") == 1).join(gone, ["lang", "start"], "left_anti")
        at = reliable_checkpoint(grown.unionByName(left.select("lang", "start", "end", "words", "counts", "flows")))
    return at


# ---------------------------------------------------------------- collocations
def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each lang."""
    nodes, words, edges = graph(docs, min_count)
    total = words.groupBy("lang").agg(F.sum("flow").alias("n"))
    f1 = words.where(F.col("flow") >= min_count)
    f2 = nodes
    runs = paths(nodes, edges)
    last = runs.select("lang", "words", "counts", "flows", "end").join(f2.select("lang", F.col("node").alias("end"), F.col("flow").alias("end_flow")), ["lang", "end"])
    # three-word phrases with the flows of both their nodes, read off the paths
    three = last.withColumn("to", F.array_append(F.slice("flows", F.lit(2), F.size("flows")), F.col("end_flow"))) \
        .select("lang", "words", F.posexplode(F.arrays_zip("counts", "flows", "to")).alias("i", "e")) \
        .select("lang", F.element_at("words", F.col("i") + 1).alias("w1"), F.element_at("words", F.col("i") + 2).alias("w2"),
                F.element_at("words", F.col("i") + 3).alias("w3"), F.col("e.counts").alias("a"), F.col("e.flows").alias("first2"), F.col("e.to").alias("last2"))
    one = lambda name, as_: f1.select("lang", F.col("word").alias(name), F.col("flow").alias(as_))
    three = reliable_checkpoint(three.join(one("w1", "first1"), ["lang", "w1"]).join(one("w3", "last1"), ["lang", "w3"]))
    # the heaviest three-word phrase around each node
    inner = three.select("lang", "a", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("node")) \
        .groupBy("lang", "node").agg(F.max("a").alias("around"))
    two = (f2.join(inner, ["lang", "node"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("flow") * 50))
           .select("lang", F.col("node").alias("phrase"), F.substring_index("node", " ", 1).alias("w1"), _second("node").alias("w2"), F.col("flow").alias("a"))
           .join(one("w1", "first1"), ["lang", "w1"]).join(one("w2", "last1"), ["lang", "w2"])
           .select("lang", "phrase", "a", F.array(_cut("first1", "last1", 1)).alias("cuts")))
    phrases = two.unionByName(three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                                           F.array(_cut("first1", "last2", 1), _cut("first2", "last1", 2)).alias("cuts")))
    scored = phrases.select("lang", "phrase", "a", F.array_min("cuts").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score") \
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # best of each salt first, so that one task sees at most SALTS * top phrases of a lang
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(left: str, right: str, k: int):
    """(score, k, l, r) of one cut: structs order by score, then by place."""
    wide = lambda c: f"cast({c} as decimal(13,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide(left)} * {wide(right)})")
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each lang of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, 1::BIGINT AS k, unnest(ws) AS phrase FROM w UNION ALL
      SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w UNION ALL
      SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) FROM w),
g AS (SELECT lang, phrase, k, count(*) AS a FROM t GROUP BY ALL),
nn AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k >= 2 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, s.j, array_to_string(string_split(c.phrase, ' ')[:s.j], ' ') AS x,
                array_to_string(string_split(c.phrase, ' ')[s.j + 1:], ' ') AS y FROM c, (VALUES (1), (2)) AS s(j) WHERE s.j < c.k),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, j, l.a AS l, r.a AS r,
              ((1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
       FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = x JOIN g r ON r.lang = cuts.lang AND r.phrase = y),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a AS f
           FROM c WHERE k = 3),
top AS (SELECT lang, phrase, max(f) AS f FROM longer GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN top ON b.k = 2 AND top.lang = b.lang AND top.phrase = b.phrase WHERE f IS NULL OR 100 * f < 50 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN nn USING (lang) WHERE rank <= 2000
"""
