"""Spelling variants by a trie self-join with active-node sets.

Words that differ by one inserted, deleted or replaced letter have all letters before it and all letters after it in common. So of two
near words, the shorter of m letters, either the first half of m agrees and the edit lies behind it, or the second half agrees and the
edit lies before it. The vocabulary's tries are partitioned by that half: each word is in the tries of both its halves, once as the shorter
and once as the longer word of a pair. A trie of too many letters is parted again, by half of what is left of its words, until a single
letter is left, of which there are only so many; so no task holds an unbounded trie, and no pair of words is compared.

Within a trie, nodes are numbered level by level, and each level's active nodes (those at most one edit from a node) come from its
parents' alone: a child by the same letter keeps the distance, another child, the node above and the children below cost one edit. All
tries of a batch go down together, as numpy arrays. A pair of nodes at distance one where words end is a pair of near words.

Cases: null and empty texts have no words; a null doc_id is the empty text in the rule that deletes letters; counts are of occurrences,
repeated rows count each; of near words with the same count the first in order of code points is the form; other columns are ignored; an
empty table gives no rows. Chains of forms end, as counts grow fivefold with each step."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, lean, table

#: What a run of letters is, and the rule that deletes one of them.
RUN, DELETE = r"[A-Za-zÀ-ÿ]", 199
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Letters of a trie's words beyond which it is parted again, and letters of a batch of tries.
TRIE = 1 << 20


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of docs (doc_id, text) that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{least_letters},}}+"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # lower() has a fast path for ASCII
    low = runs.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    h = low.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DELETE == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.expr("substring(run, cast(h % length(run) AS int) + 2)"))).otherwise(F.col("run"))
    return h.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(front: bool) -> list[Column]:
    """The window lo to hi (from the word's end) of an entry, less the half that agrees. A window of one letter of the shorter word isn't parted."""
    left = F.col("m") - F.col("lo") - F.col("hi")
    half = F.expr("(m - lo - hi) div 2").cast("int")
    return [(F.col("lo") + F.when(F.lit(front), half).otherwise(0)).cast("int").alias("lo"), (F.col("hi") + F.when(F.lit(front), 0).otherwise(left - half)).cast("int").alias("hi")]


def _parted(entries: DataFrame) -> DataFrame:
    keep = ["word", "n", "m"]
    halves = entries.select(*keep, *_part(True)).union(entries.select(*keep, *_part(False)))
    size = F.length("word") - F.col("lo") - F.col("hi")
    same = [F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - hi + 1, hi)")]  # letters only: the key is exact
    return halves.withColumn("key", F.concat_ws("|", "m", "lo", "hi", *same)).withColumn("letters", size)


def tries(words: DataFrame, most: int = TRIE) -> Iterator[DataFrame]:
    """Entries (key, m, word, n, lo, hi) of all tries with two words or more; those of more than so many letters are parted and come in a later table."""
    both = words.select("word", F.col("n"), F.length("word").alias("length"))
    entries = both.select("word", "n", F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("m")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    while True:
        parted = table(_parted(entries), "entries")
        sizes = parted.groupBy("key").agg(F.count("*").alias("words"), F.sum("letters").alias("all"), F.max(F.col("m") - F.col("lo") - F.col("hi")).alias("left")).where("words > 1")
        marked = table(parted.join(sizes.withColumn("large", (F.col("all") > most) & (F.col("left") > 1)).select("key", "large"), "key"), "marked")
        discard(parted)
        yield marked.where("NOT large")
        entries = marked.where("large").select("word", "n", "m", "lo", "hi")
        if entries.isEmpty():
            return


def _children(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node its children, one after another: places in nodes, and the children. Children of node v are first[v] to first[v + 1]."""
    n = first[nodes + 1] - first[nodes]
    at = np.repeat(np.arange(len(nodes)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[nodes][at]


def near(letters: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of the same group at distance one, in both orders; words lie one after another in letters, and no group has a word twice."""
    sizes = np.diff(offsets)
    groups, node_of = np.unique(group, return_inverse=True)  # level 0: a root for each group
    levels = int(sizes.max(initial=0))
    ends, letter, child = [], [np.zeros(len(groups), np.int64)], []  # by level: the word that ends in each node, each node's letter, where each node's children begin
    live = np.arange(len(sizes))
    for k in range(levels + 1):
        here = np.full(len(letter[k]), -1)
        done = sizes[live] == k
        here[node_of[live[done]]] = live[done]
        ends.append(here)
        live = live[~done]
        if k < levels:
            keys, number = np.unique(node_of[live] << 32 | letters[offsets[live] + k].astype(np.int64), return_inverse=True)
            node_of[live] = number
            letter.append(keys & 0xFFFFFFFF)
            child.append(np.searchsorted(keys >> 32, np.arange(len(here) + 1)))
    child.append(np.zeros(len(letter[levels]) + 1, np.int64))
    out_a, out_b = [], []

    def found(u: np.ndarray, k: int, v: np.ndarray, j: int) -> None:
        a, b = ends[k][u], ends[j][v]
        ok = (a >= 0) & (b >= 0)
        out_a.append(a[ok])
        out_b.append(b[ok])

    # active nodes of level k, beside each node itself: at distance one on the level above, on the same level and below
    roots = np.arange(len(groups))
    above = same = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, v = _children(child[0], roots)
    below = (at, v)
    for k in range(levels + 1):
        if k:
            u_all = np.arange(len(letter[k]))
            parent = np.searchsorted(child[k - 1], u_all, "right") - 1
            starts = child[k - 1]

            def down(pairs: tuple[np.ndarray, np.ndarray], level: int, k: int = k, starts: np.ndarray = starts) -> tuple[np.ndarray, np.ndarray]:
                """Children of u and of v by the same letter, for pairs of a node u of level k - 1 and a node v of some level."""
                a, x = _children(starts, pairs[0])
                b, y = _children(child[level], pairs[1][a])
                x = x[b]
                ok = letter[k][x] == letter[level + 1][y]
                return x[ok], y[ok]

            b, y = _children(starts, parent)  # brothers: one letter replaced
            other = y != u_all[b]
            new_above = [(u_all, parent)]  # its own letter inserted
            if k > 1:
                new_above.append(down(above, k - 2))
            new_same = [(u_all[b][other], y[other]), down(same, k - 1)]
            at, v = _children(child[k], u_all)
            new_below = [(u_all[at], v)]
            if k < levels:
                new_below.append(down(below, k))
            above, same, below = (_distinct(x) for x in (new_above, new_same, new_below))
        if k:
            found(above[0], k, above[1], k - 1)
        found(same[0], k, same[1], k)
        if k < levels:
            found(below[0], k, below[1], k + 1)
    return np.concatenate(out_a), np.concatenate(out_b)


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([u << 32 | v for u, v in pairs]))
    return key >> 32, key & 0xFFFFFFFF


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near, n) of entries sorted by key, whole tries at a time."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys = rows["key"].combine_chunks()
        new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        names = rows["word"].to_pylist()
        lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
        parts = [np.frombuffer(w[x : len(w) - y].encode("utf-32-le"), np.uint32) for w, x, y in zip(names, lo, hi, strict=True)]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        a, b = near(np.concatenate(parts), offsets, np.cumsum(np.append(False, new)))
        size = np.array([len(w) for w in names])
        ok = np.minimum(size[a], size[b]) == rows["m"].to_numpy()[a]  # two long words meet again as shorter ones
        a, b = a[ok], b[ok]
        word = rows["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), rows["n"].combine_chunks().take(pa.array(b))], ["word", "near", "n"])

    held, letters = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        letters += int(batch.column(6).to_numpy().sum())
        if letters > TRIE:
            rows = pa.Table.from_batches(held)
            key = rows["key"].combine_chunks()
            cut = pc.index(key, key[-1]).as_py()  # where the last trie begins
            if cut:
                yield pairs(rows.slice(0, cut))
            rest = rows.slice(cut)
            held, letters = rest.to_batches(), int(rest["letters"].to_numpy().sum())
    if held:
        yield pairs(pa.Table.from_batches(held))


def neighbours(words: DataFrame, most: int = TRIE) -> DataFrame:
    """Pairs (word, near, n of near) at distance one, in both orders, each once, of a written table of distinct words with n."""
    out = None
    for entries in tries(words, most):
        pairs = entries.select("key", "m", "word", "n", "lo", "hi", "letters").repartition("key").sortWithinPartitions("key").mapInArrow(lean(_join), "word string, near string, n long")
        out = pairs if out is None else out.union(pairs)
    return out.repartition("word").distinct()


def grouped(words: DataFrame, times: int = TIMES, most: int = TRIE) -> DataFrame:
    """word, n, n_near, form, form_n and root of a written table of distinct words with n."""
    pairs = neighbours(words, most)
    top = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("top"), F.min_by("near", F.struct(-F.col("n"), F.col("near"))).alias("form"))
    joined = words.join(top, "word", "left").withColumn("is_form", F.coalesce(F.col("top") >= times * F.col("n"), F.lit(False)))
    found = table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("form")).alias("form"),
        F.when(F.col("is_form"), F.col("top")).alias("form_n")), "forms")
    links = table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:  # each round doubles the steps; a chain has at most as many as its counts can grow fivefold
        step = table(links.join(links.toDF("root", "further"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        discard(links)
        links = step.select("word", "root")
        links._tessera_path = step._tessera_path
        if step.where("moved").isEmpty():
            break
    return found.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(vocabulary(documents(spark, sf_dir)), "words"))
